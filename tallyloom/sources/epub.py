"""Text of EPUB books: the chapters of the spine in order, markup dropped, a line feed after each."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from tallyloom.functions.markup import ENTITIES

_ENTITY = re.compile("|".join(e for e, _ in ENTITIES))


def markup_text(html: str) -> str:
    """The rules of ``tallyloom.functions.markup.html_text``, for a string."""
    text = re.sub(r"<[^>]*\Z", "", re.sub("<[^>]*>", " ", html)).replace(">", " ")
    return _ENTITY.sub(lambda m: dict(ENTITIES)[m[0]], text)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub_text(data: bytes) -> str:
    """Raises ``ValueError`` if the container, the package or the spine is missing; spine entries without a file are skipped."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        tree = ElementTree.fromstring(book.read(package))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
        raise ValueError(f"not a readable EPUB: {e}") from e
    items = {e.attrib.get("id"): e.attrib.get("href", "") for e in tree.iter() if _local(e.tag) == "item"}
    names, out = set(book.namelist()), []
    for ref in (e.attrib.get("idref") for e in tree.iter() if _local(e.tag) == "itemref"):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(items.get(ref, "").partition("#")[0])))
        if name in names:
            out.append(markup_text(book.read(name).decode("utf-8", "replace")) + "\n")
    return "".join(out)
