"""Text of HTML, as column expressions.

Tags become one space; a ``>`` outside a tag does too; a ``<`` that nothing ends swallows the rest; the bodies of scripts
and styles stay. Six entities are decoded, each once: nbsp lt gt quot apos amp.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity and character; amp comes last, so that what it makes is not decoded again.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]*>", " ")
    text = F.regexp_replace(text, r"<[^>]*\z", "")
    text = F.replace(text, F.lit(">"), F.lit(" "))
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
