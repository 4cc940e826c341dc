"""One sitemap read as a stream: inflated a piece at a time, cut into entries as they end."""

from __future__ import annotations

import codecs
import html
import re
import zlib
from collections.abc import Iterator

_PIECE = 1 << 16
#: An entry that is longer than this never ends.
_LONGEST = 1 << 20
_ROOT = re.compile(r"<(?:\w+:)?(urlset|sitemapindex)[\s>]", re.I)
_ENTRY = re.compile(r"<(?:\w+:)?(url|sitemap)(?:\s[^>]*)?>(.*?)</(?:\w+:)?\1\s*>", re.I | re.S)
_STARTS = re.compile(r"<(?:\w+:)?(?:url|sitemap)(?:\s[^>]*)?>", re.I)


def _value(block: str, tag: str) -> str | None:
    found = re.search(rf"<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}\s*>", block, re.I | re.S)
    if not found:
        return None
    text = found[1].strip()
    data = re.fullmatch(r"<!\[CDATA\[(.*)\]\]>", text, re.S)
    return (data[1] if data else html.unescape(text)).strip()


def inflated(raw, most: int) -> Iterator[bytes]:
    """Pieces of a body of at most 64 KB; raises OverflowError beyond most bytes, zlib.error where gzip is broken or ends early."""
    raw, total = memoryview(raw), 0
    if raw[:2].tobytes() != b"\x1f\x8b":
        for at in range(0, len(raw), _PIECE):
            piece = raw[at : at + _PIECE].tobytes()
            yield piece[: most - total]
            total += len(piece)
            if total > most:
                raise OverflowError
        return
    at, machine = 0, zlib.decompressobj(31)
    while at < len(raw):
        data = raw[at : at + _PIECE].tobytes()
        at += len(data)
        while data:
            piece = machine.decompress(data, _PIECE)
            if piece:
                yield piece[: most - total]
            total += len(piece)
            if total > most:
                raise OverflowError
            data = machine.unconsumed_tail
            if machine.eof:
                # Members may follow each other; zeros may follow the last one.
                data = machine.unused_data.lstrip(b"\0")
                if data:
                    machine = zlib.decompressobj(31)
                elif at >= len(raw):
                    return
        if machine.eof:
            machine = zlib.decompressobj(31) if raw[at : at + 2].tobytes() == b"\x1f\x8b" else machine
            if machine.eof:
                return
    if not machine.eof:
        raise zlib.error("the body ends early")


def uncommented(texts: Iterator[str]) -> Iterator[str]:
    """Pieces of a text without its comments, which may begin in one piece and end in another."""
    text, inside = "", False
    for piece in texts:
        text, out = text + piece, []
        while True:
            at = text.find("-->" if inside else "<!--")
            if at < 0:
                break
            if not inside:
                out.append(text[:at] + " ")
            text, inside = text[at + (3 if inside else 4) :], not inside
        if inside:
            text = text[-2:]
        else:
            begun = next((n for n in (3, 2, 1) if text.endswith("<!--"[:n])), 0)
            out.append(text[: len(text) - begun])
            text = text[len(text) - begun :]
        yield "".join(out)
    if not inside:
        yield text


def sitemap_rows(raw, most: int) -> Iterator[dict]:
    """A row an entry (kind, at, raw, lastmod) while reading, and at the end one for the file (kind, gzipped, bytes, entries, error, limit_hit)."""
    end = {"kind": "unknown", "gzipped": bytes(memoryview(raw)[:2]) == b"\x1f\x8b", "bytes": 0, "entries": 0, "error": None, "limit_hit": None}

    def decoded() -> Iterator[str]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        try:
            for piece in inflated(raw, most):
                end["bytes"] += len(piece)
                yield decoder.decode(piece)
        except OverflowError:
            end["error"], end["limit_hit"] = "too_large", "max_bytes"
        except zlib.error:
            end["error"] = "gunzip_failed"
        yield decoder.decode(b"", True)

    text, wanted = "", None
    for piece in uncommented(decoded()):
        text += piece
        if wanted is None:
            if not (root := _ROOT.search(text)):
                text = text[-_LONGEST:]
                continue
            end["kind"] = root[1].lower()
            wanted = "url" if end["kind"] == "urlset" else "sitemap"
            text = text[root.end() - 1 :]
        over = 0
        for found in _ENTRY.finditer(text):
            over = found.end()
            if found[1].lower() == wanted:
                yield {"kind": end["kind"], "at": end["entries"], "raw": _value(found[2], "loc") or "", "lastmod": _value(found[2], "lastmod") or None}
                end["entries"] += 1
        text = text[over:]
        # What no entry can begin in is dropped, and so is one that doesn't end.
        start = _STARTS.search(text)
        text = text[-256:] if start is None or len(text) - start.start() > _LONGEST else text[start.start() :]
    if wanted is None and end["error"] is None:
        end["error"] = "not_a_sitemap"
    yield end
