"""Chat formatting for preference training.

Two conversations that begin alike make a pair: their longest common prefix of turns is rendered once as the prompt, and
what follows in each is a completion, with the spans of assistant turns in it as the loss mask.

``preference_pairs`` finds pairs among conversations with the same first turn: in the order of a hash of their ids, each
odd one goes with the next even one, and of the two the one with more assistant text is chosen (ties: the smaller id). So a
group of any size yields half as many pairs as it has conversations, never all pairs. Ranks in a group are sums over
ranges of the hash plus a rank within a range, so no group is sorted in one task. A conversation without a partner is
kept as a row whose prompt ends before its last assistant turn and which has no rejected side.

Defined cases: null roles and texts count as empty; equal rows of one turn count once; turns of equal number stand in the
order of role and text; rows with a null conversation id are one conversation; conversations of any length are
rendered whole; an empty table gives no rows; extra columns are not read. The mark ``<|`` inside a text is written ``< |``.
status: 'pair'; 'same' if nothing follows the common prefix on either side; 'cut' if nothing follows on one; 'single'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.spill import join_counted, written

_RANGE = 2048  # conversations in one range of the hash, about


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation as an array of (turn, role, text)."""
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.select(F.col(id_col).cast("bigint").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def hashed(conv_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(conv_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def assistant_chars(turns: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("bigint"), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))


def _turn_text(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn_text), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) in characters of the texts of assistant turns, within ``rendered(turns)``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        size = F.length(_turn_text(t)).cast("bigint")
        begin = acc["at"] + F.length(t["role"]) + 5
        span = F.array(F.struct(begin.alias("start"), (acc["at"] + size - 1).alias("end")))
        return F.struct((acc["at"] + size).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(a: str, b: str) -> Column:
    """How many turns two arrays share at their beginning."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From (chosen_id, chosen, rejected_id, rejected) with arrays of turns, rejected null for singles:

    (chosen_id, rejected_id, status, n_prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask).
    """
    last = F.aggregate(F.sequence(F.lit(1), F.size("chosen")), F.lit(0), lambda n, i: F.when(F.element_at("chosen", i)["role"] == "assistant", i).otherwise(n))
    single = F.col("rejected").isNull()
    k = F.when(single, F.when(last > 0, last - 1).otherwise(F.size("chosen"))).otherwise(common_turns("chosen", "rejected"))
    cut = pairs.withColumn("_k", k.cast("int"))
    chosen, rejected = (F.slice(c, F.col("_k") + 1, F.greatest(F.size(c), F.lit(0))) for c in ("chosen", "rejected"))
    left = [F.size(c) > F.col("_k") for c in ("chosen", "rejected")]
    status = F.when(single, "single").when(left[0] & left[1], "pair").when(left[0] | left[1], "cut").otherwise("same")
    return cut.select(
        "chosen_id", "rejected_id", status.alias("status"), F.col("_k").alias("n_prompt_turns"),
        rendered(F.slice("chosen", F.lit(1), F.col("_k"))).alias("prompt"),
        rendered(chosen).alias("chosen_text"), trained_spans(chosen).alias("chosen_mask"),
        F.when(~single, rendered(rejected)).alias("rejected_text"), F.when(~single, trained_spans(rejected)).alias("rejected_mask"))


def preference_pairs(convs: DataFrame) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected) from (conv_id, turns); rejected is null where there is no partner."""
    first = F.get("turns", F.lit(0))
    keyed = written(convs.select("*", F.sha2(F.concat_ws("\x1f", first["role"], first["text"]), 256).alias("key"), hashed(F.col("conv_id")).alias("h"),
                                 assistant_chars("turns").alias("pref")), "conversations")
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "first-turns")
    slim = join_counted(keyed.select("conv_id", "key", "h"), sizes, ["key"], "n", keyed.count())
    slim = slim.withColumn("b", F.expr(f"shiftright(h, 60 - length(bin(n div {_RANGE})))"))
    ranges = slim.groupBy("key", "b").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("key", "b").orderBy("h", "conv_id"))
    ranked = slim.withColumn("r", inside).join(ranges.select("key", "b", "before"), ["key", "b"])
    ranked = ranked.select(F.col("conv_id").alias("_id"), F.concat_ws(":", "key", ((F.col("r") + F.col("before") - 1) / 2).cast("bigint").cast("string")).alias("pair"))
    side = F.struct((-F.col("pref")).alias("pref"), "conv_id", "turns")
    both = keyed.join(ranked, keyed["conv_id"].eqNullSafe(ranked["_id"])).groupBy("pair").agg(F.sort_array(F.collect_list(side)).alias("two"))
    one, two = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return both.select(one["conv_id"].alias("chosen_id"), one["turns"].alias("chosen"), two["conv_id"].alias("rejected_id"), two["turns"].alias("rejected"))


def preferences(turns: DataFrame) -> DataFrame:
    """Rendered pairs and singles of a table of turns."""
    return format_pairs(preference_pairs(conversations(turns)))
