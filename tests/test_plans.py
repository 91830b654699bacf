"""Configuration, modes, jobs, service, command line, streaming."""

import json
import time

import pytest

from tallyloom.__main__ import main
from tallyloom.plans.config import Config, ConfigError, Memory, Sample, decide_mode, escape_separator, parse_size, percent, preview_separator, unescape_separator
from tallyloom.plans.job import Busy, JobManager, summarize, warnings
from tallyloom.plans.service import CommandError, FrequencyRequest, FuzzyRequest, JobRequest, NgramRequest, Service, SetOpRequest
from tallyloom.streaming.distinct import stream_distinct, stream_frequency

GIB, MIB = 1 << 30, 1 << 20


@pytest.mark.parametrize(("change", "kind"), [
    ({"inputs": []}, "NoInputs"), ({"output": ""}, "NoOutput"), ({"output_separator": ""}, "EmptySeparator"), ({"drop_length_min": 0, "drop_length_max": 3}, "DropLengthMinOutOfRange"),
    ({"drop_length_min": 1, "drop_length_max": 11}, "DropLengthMaxOutOfRange"), ({"drop_length_min": 4, "drop_length_max": 3}, "DropLengthRangeInverted"),
    ({"disk_buckets": 7}, "DiskBucketsTooSmall"), ({"disk_run_bytes": 999_999}, "DiskRunBytesTooSmall"), ({"mode": "x"}, "Mode"), ({"ordering": "x"}, "Ordering")])
def test_validation(change, kind):
    with pytest.raises(ConfigError) as e:
        Config(**({"inputs": ["a"], "output": "b"} | change)).validate()
    assert e.value.kind == kind
    Config(inputs=["a"], output="b", drop_length_min=99).validate()


def test_texts():
    assert unescape_separator(r"\n\t\r\f\\\x\rn") == "\n\t\r\f\\\\x\r\n" and unescape_separator("a\\") == "a\\"
    assert escape_separator("\r\n\t\\") == r"\r\n\t\\" and preview_separator("\r\n\t\x0c") == "␍↵⇥␌"
    assert [parse_size(x) for x in ("42", "1KB", "2mb", "3G")] == [42, 1024, 2 * MIB, 3 * GIB]
    for bad in ("abc", "10XB", ""):
        with pytest.raises(ConfigError):
            parse_size(bad)
    assert percent(3, 6) == 50.0 and percent(1, 0) == 0.0 and percent(1, 3) == 33.33 and percent(1, 800) == 0.13


@pytest.mark.parametrize(("files", "size", "sample", "memory", "mode", "reason"), [
    (1, 32 * MIB, Sample(1000, 1000, 0, 8, 0.1), Memory(16 * GIB, 8 * GIB, 8 * GIB), "ram", "single_file_within_50pct_usable_memory"),
    (2, 256 * MIB, Sample(1000, 600, 400, 8, 0.1), Memory(16 * GIB, 8 * GIB, 8 * GIB), "disk", "multi_file_partial_overlap_prefers_disk"),
    (1, 64 * MIB + 1, Sample(), Memory(4 * GIB, 1400 * MIB, 0), "disk", "usable_memory_below_512mb_with_large_input"),
    (1, 10 * GIB, Sample(1000, 1000, 0, 8, 0.1), Memory(16 * GIB, 8 * GIB, 0), "disk", "estimated_ram_exceeds_70pct_usable_memory"),
    (1, 3 * GIB, Sample(), Memory(16 * GIB, 0, 4 * GIB), "disk", "available_memory_zero_fallback_to_free_memory"),
    (1, 9 * GIB, Sample(), Memory(16 * GIB, 0, 0), "disk", "available_memory_zero_fallback_to_total_memory"),
    (1, 1, Sample(), Memory(0, 0, 0), "ram", "available_memory_zero_fallback_ram"),
    (3, 1, Sample(), Memory(16 * GIB, 8 * GIB, 0), "ram", "estimated_ram_fits_usable_memory"),
    (3, 1, Sample(), Memory(4 * GIB, 100, 0), "ram", "usable_memory_zero_but_input_small")])
def test_modes(files, size, sample, memory, mode, reason):
    found = decide_mode(files, size, sample, memory)
    assert (found.mode, found.reason) == (mode, reason)


def finished(jobs):
    events = []
    while not events or events[-1].type != "summary":
        event = jobs.next_event_timeout(120)
        assert event is not None
        events.append(event)
    return events


def test_job(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a,b,b;c\na c")
    jobs = JobManager(spark)
    config = Config(inputs=[str(tmp_path / "a.txt")], output=str(tmp_path / "o.txt"), mode="ram", output_separator=",", per_file_stats=True)
    job = jobs.start_job(config)
    with pytest.raises(Busy):
        jobs.start_job(config)
    events = finished(jobs)
    assert events[0].type == "started" and events[-2].type == "done" and not jobs.is_running()
    s = events[-1].body["summary"]
    assert (s["job_id"], s["status"], s["tokens_seen"], s["unique_tokens"], s["duplicates"], s["reduction_pct"], s["uniq_pct"]) == (job, "success", 6, 3, 3, 50.0, 50.0)
    assert (tmp_path / "o.txt").read_text() == "a,b,c" and s["output_bytes"] == 5 and s["input_bytes_total"] == 11
    assert s["per_file"][0]["unique_new"] == 3 and s["mode_effective"] == "ram" and json.loads(events[-1].to_json())["type"] == "summary"
    assert "Tokenizing" in s["stage_durations_ms"] and events[-1].topic == "job://summary"


def test_job_fails_and_is_cancelled(spark, tmp_path):
    jobs = JobManager(spark)
    jobs.start_job(Config(inputs=[str(tmp_path / "none.txt")], output=str(tmp_path / "o.txt")))
    events = finished(jobs)
    assert events[-2].type == "error" and events[-1].body["summary"]["status"] == "error" and not (tmp_path / "o.txt").exists()
    (tmp_path / "a.txt").write_text("a b c")
    job = jobs.start_job(Config(inputs=[str(tmp_path / "a.txt")], output=str(tmp_path / "o.txt")))
    assert jobs.cancel_job(job) and not jobs.cancel_job("other")
    events = finished(jobs)
    assert events[-1].body["summary"]["status"] == "canceled" and not (tmp_path / "o.txt").exists()
    jobs.start_job(Config(inputs=[str(tmp_path / "a.txt")], output=str(tmp_path / "o.txt"), mode="auto"))
    summary = finished(jobs)[-1].body["summary"]
    assert summary["auto_decision_reason"] and summary["auto_sample_tokens"] == 3


def test_warnings():
    config = Config(inputs=["a"], output="b", ordering="unordered", output_separator="\r\n")
    assert len(warnings(config, "success", 85.0, 15.0, ["x.pdf: broken"])) == 5
    assert len(warnings(Config(inputs=["a"], output="b"), "success", 0.0, 0.0, [])) == 1  # an empty input has no unique tokens
    assert summarize("j", Config(inputs=[], output=""), "error", time.time(), time.time(), None, "e").error_message == "e"


def test_service(spark, tmp_path):
    service = Service(spark)
    left, right, out = (str(tmp_path / n) for n in ("l.txt", "r.txt", "o.txt"))
    (tmp_path / "l.txt").write_text("c b a b")
    (tmp_path / "r.txt").write_text("b d")
    with pytest.raises(CommandError) as e:
        service.start_job(JobRequest(inputs=[], output=out))
    assert e.value.category == "invalid_config"
    assert service.frequency(FrequencyRequest(inputs=[left], top_n=1)) == {"entries": [("b", 2)], "tokens_seen": 4, "unique_tokens": 3}
    assert service.frequency(FrequencyRequest())["entries"] == []
    found = service.set_operation(SetOpRequest(inputs=[left], right=[right], op="diff", output=out, output_separator=r"\t", interpret_separator_escapes=True))
    assert (tmp_path / "o.txt").read_text() == "c\ta" and found["tokens_seen"] == 6 and found["unique_tokens"] == 2
    with pytest.raises(CommandError) as e:
        service.set_operation(SetOpRequest(inputs=[left], right=[], op="diff", output=out))
    assert e.value.category == "output_exists"
    assert service.fuzzy(FuzzyRequest(inputs=[left], output=out, allow_overwrite=True))["clusters_found"] == 1
    assert service.ngrams(NgramRequest(inputs=[left], output=out, allow_overwrite=True, n=2))["ngrams_seen"] == 3
    with pytest.raises(CommandError) as e:
        service.fuzzy(FuzzyRequest(inputs=[left], output=out, allow_overwrite=True, max_edit_distance=11))
    assert e.value.category == "invalid_config"
    with pytest.raises(CommandError) as e:
        service.check_word("a")
    assert e.value.category == "checker_not_loaded"
    assert service.load_word_list(left) == 3 and service.check_word("a") == (True, 3) and service.check_word(" a") == (False, 3)
    with pytest.raises(CommandError) as e:
        service.load_word_list(str(tmp_path / "none"))
    assert e.value.category == "runtime_error"
    assert service.runtime_state() == {"running": False, "active_job_id": None} and service.app_info()["version"]
    service.start_job(JobRequest(inputs=[left], output=out, allow_overwrite=True, mode="disk", ordering="alphabetical", disk_alphabetical_mode="global-perfect"))
    finished(service.jobs)
    assert (tmp_path / "o.txt").read_text() == "a\nb\nc" and service.next_events(0, 1) == []


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("x;z,y,x")
    a, o = str(tmp_path / "a.txt"), str(tmp_path / "o.txt")
    assert main(["dedupe", "-i", a, "-o", o, "--separator", ",", "--benchmark-json", "--quiet"], spark) == 0
    assert (tmp_path / "o.txt").read_text() == "x,z,y" and json.loads(capsys.readouterr().out)["unique_tokens"] == 3
    assert main(["dedupe", "-i", a, "-o", o], spark) == 2
    assert main(["frequency", "-i", a, "--top", "1", "--quiet"], spark) == 0 and capsys.readouterr().out == "2\tx\n"
    assert main(["check", "-i", a, "--word", "x", "q"], spark) == 0 and capsys.readouterr().out == "x\tTrue\nq\tFalse\n"
    assert main(["set", "-i", a, "-o", o, "--overwrite", "--op", "diff", "--right", a], spark) == 0 and (tmp_path / "o.txt").read_text() == ""


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("a b a\nc")
    (src / "2.txt").write_text("b d")
    stream = spark.readStream.text(str(src)).withColumnRenamed("value", "text")
    for make, mode, want in ((stream_distinct, "append", ["a", "b", "c", "d"]), (stream_frequency, "complete", [("a", 2), ("b", 2), ("c", 1), ("d", 1)])):
        query = make(stream).writeStream.outputMode(mode).format("memory").queryName(make.__name__).option("checkpointLocation", str(tmp_path / make.__name__)).start()
        query.processAllAvailable()
        query.stop()
        rows = sorted(tuple(r) for r in spark.table(make.__name__).collect())
        assert rows == [w if isinstance(w, tuple) else (w,) for w in want]
