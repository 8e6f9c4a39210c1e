"""Text of PDF files by the standard library: page texts in order, blank pages left out, joined by line feeds.

Reads objects wherever they stand (also in compressed object streams), content streams that are plain or deflated, and the fonts'
maps to Unicode. Encrypted files and other filters give an error or no text; an engine for them can be plugged in as a parser.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _data(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in body[: found.start()] else found[1]


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in [b for b in found.values() if b"/ObjStm" in b]:
        inner, first = _data(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = list(map(int, inner[:first].split()))
        for k in range(0, len(numbers), 2):
            end = first + numbers[k + 3] if k + 3 < len(numbers) else len(inner)
            found.setdefault(numbers[k], inner[first + numbers[k + 1] : end])
    return found


def _pages(objects: dict[int, bytes], number: int, seen: set[int]) -> list[int]:
    body = objects.get(number, b"")
    kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
    if number in seen or not body:
        return []
    seen.add(number)
    return [p for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]) for p in _pages(objects, int(k), seen)] if kids else [number]


def _unicode_map(data: bytes) -> dict[bytes, str]:
    out, text = {}, lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            low, high, size, base = int(a, 16), int(b, 16), len(a) // 2, text(to)
            out |= {(low + k).to_bytes(size, "big"): base[:-1] + chr(ord(base[-1]) + k) for k in range(min(high - low, 65_535) + 1)}
    return out


def _string(token: bytes, known: dict[bytes, str]) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)
    if known:
        size = len(next(iter(known)))
        return "".join(known.get(raw[k : k + size], "") for k in range(0, len(raw), size))
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """What the text operators of a content stream show; a move to another line is a line feed, a wide gap a space."""
    out, stack, known = [], [], {}
    for token in _TOKEN.findall(content):
        if token[:1].isalpha() or token in (b"'", b'"', b"T*"):
            if token == b"Tf":
                known = next((fonts[x] for x in stack if x in fonts), {})
            elif token in (b"'", b'"', b"T*", b"Td", b"TD", b"Tm", b"ET"):
                flat = token in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1]) == 0
                out.append(" " if flat else "\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                for x in stack:
                    if x[:1] in (b"(", b"<"):
                        out.append(_string(x, known))
                    elif token == b"TJ" and re.fullmatch(rb"-?\d+(\.\d+)?", x) and float(x) < -200:
                        out.append(" ")
            stack = []
        else:
            stack.append(token)
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def parse_pdf(name: str, data: bytes) -> str:
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF file")
    if b"/Encrypt" in data:
        raise ValueError("an encrypted PDF file")
    objects = _objects(data)
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b] or sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b))
    seen: set[int] = set()
    texts = []
    for number in [p for r in roots for p in _pages(objects, r, seen)]:
        body = objects[number]
        place = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        content = b"\n".join(_data(objects.get(int(r), b"")) for r in re.findall(rb"(\d+)\s+\d+\s+R", place[1])) if place else b""
        fonts = {}
        resources = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body)
        named = body + (objects.get(int(resources[1]), b"") if resources else b"")
        apart = re.search(rb"/Font\s+(\d+)\s+\d+\s+R", named)
        for font, ref in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named + (objects.get(int(apart[1]), b"") if apart else b"")):
            if to := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(int(ref), b"")):
                fonts[font] = _unicode_map(_data(objects.get(int(to[1]), b"")))
        if text := page_text(content, fonts):
            texts.append(text)
    return "\n".join(texts)
