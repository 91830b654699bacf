"""Text of simple PDF files: strings shown on each page, in the order of pages, a line feed after each page.

Reads classic and compressed objects, Flate streams, and strings in the fonts' one-byte codes or, where the font has a
ToUnicode table, through it. Files encrypted with an empty user password (RC4) are opened. What else there is raises
``ValueError``, so that the caller reports the file as not extracted.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from typing import Any

_DELIMITERS = b"()<>[]{}/%"
_BLANK = b"\0\t\n\f\r "
#: Fixed value: the padding string of the standard security handler.
_PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


class Name(str):
    pass


class Operator(bytes):
    pass


@dataclass
class Stream:
    attributes: dict
    data: bytes
    owner: Ref | None = field(default=None)


class _Parser:
    """Reads objects from bytes; in content streams words that are no objects are ``Operator``s."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _BLANK:
                self.at += 1
            elif d[self.at : self.at + 1] == b"%":
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def read(self) -> Any:
        self.skip()
        d, c = self.data, self.data[self.at : self.at + 1]
        if not c:
            raise EOFError
        if c == b"/":
            word = self._word(1)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word).decode("latin-1"))
        if c == b"(":
            return self._literal()
        if d.startswith(b"<<", self.at):
            self.at += 2
            out = {}
            while True:
                self.skip()
                if self.data.startswith(b">>", self.at):
                    self.at += 2
                    return out
                key = self.read()
                out[key] = self.read()
        if c == b"<":
            end = d.index(b">", self.at)
            digits = re.sub(rb"\s", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.data.startswith(b"]", self.at):
                    self.at += 1
                    return out
                out.append(self.read())
        if c in (b"]", b">", b"{", b"}", b")"):
            self.at += 1
            return Operator(c)
        found = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z0-9])").match(d, self.at)
        if found:
            self.at = found.end()
            return Ref(int(found[1]), int(found[2]))
        word = self._word(0)
        if re.fullmatch(rb"[+-]?\d+", word):
            return int(word)
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word))

    def _word(self, skipped: int) -> bytes:
        start = self.at = self.at + skipped
        while self.at < len(self.data) and self.data[self.at] not in _BLANK and self.data[self.at] not in _DELIMITERS:
            self.at += 1
        return self.data[start : self.at]

    def _literal(self) -> bytes:
        out, depth = bytearray(), 0
        codes = {b"n": 10, b"r": 13, b"t": 9, b"b": 8, b"f": 12}
        while True:
            c = self.data[self.at : self.at + 1]
            if not c:
                raise EOFError
            self.at += 1
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(self.data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                e = self.data[self.at : self.at + 1]
                self.at += 1
                if e == b"\r" and self.data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                elif e not in (b"\r", b"\n"):
                    out.append(codes.get(e, e[0] if e else 0))
                continue
            depth += (c == b"(") - (c == b")")
            if depth == 0:
                return bytes(out)
            if not (c == b"(" and depth == 1):
                out += c


def _rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF")
        self.objects: dict[int, Any] = {}
        self.trailer: dict = {}
        self.key: bytes | None = None
        self._scan(data)
        if "Encrypt" in self.trailer:
            self._open()
        self._unpack()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
            if root is None:
                raise ValueError("the PDF has no catalogue")
            self.trailer["Root"] = root

    def _scan(self, data: bytes) -> None:
        """All objects as they stand in the file; a later one of the same number replaces an earlier one."""
        at = 0
        marks = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b|\btrailer\b")
        while found := marks.search(data, at):
            at = found.end()
            try:
                parser = _Parser(data, at)
                value = parser.read()
            except (EOFError, ValueError):
                continue
            if found[1] is None:
                if isinstance(value, dict):
                    self.trailer = self.trailer | value
                continue
            at = parser.at
            parser.skip()
            if isinstance(value, dict) and data.startswith(b"stream", parser.at):
                start = parser.at + 6
                start += 2 if data.startswith(b"\r\n", start) else 1
                size = value.get("Length")
                end = start + size if isinstance(size, int) else -1
                if end < start or not re.match(rb"\s*endstream", data[end : end + 16]):
                    end = data.find(b"endstream", start)
                    if end < 0:
                        continue
                    if data[end - 1 : end] == b"\n":
                        end -= 1
                    if data[end - 1 : end] == b"\r":
                        end -= 1
                value = Stream(value, data[start:end], Ref(int(found[1]), int(found[2])))
                at = end
                if value.attributes.get("Type") == "XRef":
                    self.trailer = {k: v for k, v in value.attributes.items() if k in ("Root", "Encrypt", "ID")} | self.trailer
            self.objects[int(found[1])] = value

    def _open(self) -> None:
        """The key for an empty user password."""
        rules = self.get(self.trailer["Encrypt"])
        if rules.get("Filter") != "Standard" or rules.get("V", 0) not in (1, 2):
            raise ValueError("the PDF's encryption is not supported")
        size = 5 if rules["V"] == 1 else rules.get("Length", 40) // 8
        first = self.get(self.trailer.get("ID", [b""]))[0]
        key = hashlib.md5(_PADDING + rules["O"] + struct.pack("<i", rules["P"]) + first).digest()
        if rules.get("R", 2) >= 3:
            for _ in range(50):
                key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if rules.get("R", 2) == 2:
            fits = _rc4(self.key, _PADDING) == rules["U"]
        else:
            check = _rc4(self.key, hashlib.md5(_PADDING + first).digest())
            for i in range(1, 20):
                check = _rc4(bytes(b ^ i for b in self.key), check)
            fits = check == rules["U"][:16]
        if not fits:
            raise ValueError("the PDF needs a password")

    def _unpack(self) -> None:
        """Objects within object streams."""
        for stream in [o for o in self.objects.values() if isinstance(o, Stream) and o.attributes.get("Type") == "ObjStm"]:
            body = self.content(stream)
            head = _Parser(body)
            numbers = [head.read() for _ in range(2 * self.get(stream.attributes["N"]))]
            for number, at in zip(numbers[::2], numbers[1::2], strict=True):
                self.objects.setdefault(number, _Parser(body, self.get(stream.attributes["First"]) + at).read())

    def get(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        raise ValueError("references go in a circle")

    def content(self, stream: Stream) -> bytes:
        data = stream.data
        if self.key and stream.owner:
            salt = struct.pack("<I", stream.owner.number)[:3] + struct.pack("<I", stream.owner.generation)[:2]
            data = _rc4(hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)], data)
        filters = self.get(stream.attributes.get("Filter", []))
        for name in filters if isinstance(filters, list) else [filters]:
            if self.get(name) not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name} is not supported")
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error as e:
                raise ValueError(f"a stream is damaged: {e}") from e
        parms = self.get(stream.attributes.get("DecodeParms"))
        if isinstance(parms, dict) and self.get(parms.get("Predictor", 1)) > 1:
            raise ValueError("predictors are not supported")
        return data

    def pages(self) -> list[dict]:
        out: list[dict] = []

        def walk(node: Any, held: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                raise ValueError("the page tree is damaged")
            held = held | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]):
                    walk(kid, held, depth + 1)
            else:
                out.append(held | node)

        walk(self.get(self.trailer["Root"])["Pages"], {}, 0)
        return out

    def page_text(self, page: dict) -> str:
        parts = self.get(page.get("Contents", []))
        body = b"\n".join(self.content(self.get(p)) for p in (parts if isinstance(parts, list) else [parts]))
        fonts = self.get((self.get(page.get("Resources", {})) or {}).get("Font", {})) or {}
        tables = {name: self._table(self.get(font)) for name, font in fonts.items()}
        parser, stack, out, table = _Parser(body), [], [], None
        while True:
            try:
                value = parser.read()
            except EOFError:
                return "".join(out)
            if not isinstance(value, Operator):
                stack.append(value)
                continue
            if value == b"Tf" and len(stack) >= 2:
                table = tables.get(stack[-2])
            elif value in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                out += ["\n"] * (value != b"Tj") + [self._shown(stack[-1], table)]
            elif value == b"TJ" and stack and isinstance(stack[-1], list):
                out += [self._shown(x, table) if isinstance(x, bytes) else " " * (isinstance(x, (int, float)) and x < -200) for x in stack[-1]]
            elif value in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                out.append("\n" if out and not out[-1].endswith("\n") else "")
            stack = []

    def _table(self, font: Any) -> tuple[int, dict[int, str]] | None:
        """(bytes of a code, text of each code) of a font's ToUnicode table."""
        stream = self.get(font.get("ToUnicode")) if isinstance(font, dict) else None
        if not isinstance(stream, Stream):
            return None
        body, out, size = self.content(stream), {}, 1
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.DOTALL):
            for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[int(code, 16)], size = bytes.fromhex(text.decode()).decode("utf-16-be", "replace"), max(size, len(code) // 2)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.DOTALL):
            for low, high, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                size = max(size, len(low) // 2)
                for i, code in enumerate(range(int(low, 16), min(int(high, 16), int(low, 16) + 65535) + 1)):
                    out[code] = chr(int(text, 16) + i) if len(text) <= 4 else ""
        return size, out

    @staticmethod
    def _shown(data: bytes, table: tuple[int, dict[int, str]] | None) -> str:
        if table is None:
            return data.decode("cp1252", "replace")
        size, texts = table
        return "".join(texts.get(int.from_bytes(data[i : i + size]), "") for i in range(0, len(data), size))


def pdf_text(data: bytes) -> str:
    try:
        document = Document(data)
        return "".join(document.page_text(p).rstrip("\n") + "\n" for p in document.pages())
    except (KeyError, IndexError, TypeError, AttributeError, EOFError, RecursionError) as e:
        raise ValueError(f"not a readable PDF: {e!r}") from e
