"""Exact token ids of whole texts by the tokenizers library, remembered by piece between blanks.

Both vocabularies cut every text before a blank that precedes a visible character (or at it), whatever stands around
it, and at a line feed between visible characters, so a text's ids are those of its pieces in turn. Pieces repeat, so
their ids are kept as bytes in a bounded cache.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: A blank before which a text cannot be cut: what follows is white space (by any version of Unicode) or nothing.
_UNCUT = re.compile(" (?=[\\s\u180e\u200b\ufeff]|\\Z)")
#: A line feed beside other white space, with which it may be one piece.
_RUN = re.compile("\n(?:(?=[\\s\u180e\u200b\ufeff])|(?<=[\\s\u180e\u200b\ufeff]\n))")
_CUT = re.compile(" (?=[^\\s\u180e\u200b\ufeff])")
_MARKS = tuple(".,!?;:")
#: A mark between an ASCII letter and a blank is a piece; where blanks count, one behind this sign, which has none before it.
_MARKED, _SIGN = "([A-Za-z])([.,!?;:]) ", "\x01"
#: Longer pieces are not kept.
_LONG = 48
#: Pieces that a worker keeps at most, at about 250 bytes each; others are encoded again.
KEPT = 1_500_000
#: How byte-level vocabularies write the bytes that are not printable in Latin-1, in order.
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Texts are taken together, and long ones in parts, of about so many characters.
_BLOCK = 1 << 22


# Fixed values: (normalizer, pre-tokenizer) of files that are known to cut as told above, with and without blanks.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_CUTTING = {
    True: (None, _BYTES | {"use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            _BYTES | {"use_regex": False},
        ]},
    ),
}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to Tokenizer.encode(add_special_tokens=False).

    blanks: whether a blank belongs to the piece after it (a byte-level vocabulary) or to none (a word vocabulary that
    drops white space). A special token that a text spells is its id, as in the library, and parts the text. With a file
    whose normalizer, pre-tokenizer, model or added tokens are other ones, the library encodes each text as a whole.
    """

    def __init__(self, path: str, blanks: bool, most: int = KEPT):
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        added, model = said["added_tokens"], said["model"]
        plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        self.known = plain and (said["normalizer"], said["pre_tokenizer"]) == _CUTTING[blanks] and (
            model["type"] == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"))
        )
        if not self.known:
            return
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.parted = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokenizer.encode_special_tokens = True  # what is left between them is ordinary, in lower case too
        self.blanks = blanks
        self.kept: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.marks = {"": b""} | dict(zip(_MARKS, self._ids(list(_MARKS))))
        if blanks:
            self.kept.update((_SIGN + mark, self.marks[mark]) for mark in _MARKS)
            self.marks["\n"] = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", made.ids).tobytes() for made in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> list[bytes]:
        """The ids of stems, after a blank where the vocabulary keeps it. Letters of Latin-1 alone are one composed word,
        and go to the library's merges directly, in the letters that stand for their bytes."""
        before, merge = "\u0120" if self.blanks else "", self.tokenizer.model.tokenize
        plain = [s.isalpha() and (s.isascii() or max(s) < "\u0100") for s in stems]
        others = iter(self._ids([" " + s if self.blanks else s for s, p in zip(stems, plain) if not p]))
        out, collects = [], gc.isenabled()
        gc.disable()  # the many small objects below hold no cycles
        for s, p in zip(stems, plain):
            if p and not s.isascii():
                s = (s if self.blanks else s.lower()).encode().decode("latin-1").translate(_BYTE_LETTERS)
            out.append(array("I", [t.id for t in merge(before + s)]).tobytes() if p else next(others))
        if collects:
            gc.enable()
        return out

    def _learned(self, new: list[str]) -> list[bytes]:
        """The ids of new pieces, by their stems: a mark after an ASCII letter is an id of its own, and so is a line feed
        at the start, which stands for the blank before the piece."""
        kept = self.kept
        if self.blanks and (lines := [k for k, p in enumerate(new) if p[:1] == "\n"]):
            made = [self.marks["\n"] + ids for ids in self._opening([new[k][1:] for k in lines])]
            rest = iter(self._learned([p for p in new if p[:1] != "\n"]))
            told = dict(zip(lines, made))
            return [told[k] if k in told else next(rest) for k in range(len(new))]
        stems, marks = [], []
        for piece in new:
            mark = ""
            if piece[-1:] in _MARKS and piece[-2:-1].isascii() and piece[-2:-1].isalpha():
                mark, piece = piece[-1], piece[:-1]
            stems.append(piece.lower() if not self.blanks and piece.isascii() else piece)
            marks.append(self.marks[mark])
        own = dict(zip(stems, map(kept.get, stems)))
        fresh = [s for s, ids in own.items() if ids is None]
        made = self._stems(fresh)
        own.update(zip(fresh, made))
        if len(kept) < self.most:
            kept.update((s, ids) for s, ids in zip(fresh, made) if len(s) <= _LONG)
        return [own[s] + mark for s, mark in zip(stems, marks)]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces. Those of letters alone, most of the new ones, are stems already."""
        kept = self.kept
        found = list(map(kept.get, pieces))
        new = [p for p, ids in zip(pieces, found) if ids is None]
        if not new:
            return found  # type: ignore[return-value]
        stems = [p for p in new if p.isalpha() and (self.blanks or p.islower() or not p.isascii())]
        own = dict(zip(stems, self._stems(stems)))
        rest = [p for p in new if p not in own]
        own.update(zip(rest, self._learned(rest)))
        if len(kept) < self.most:
            kept.update(own if max(map(len, new)) <= _LONG else {p: ids for p, ids in own.items() if len(p) <= _LONG})
        return [own[p] if ids is None else ids for p, ids in zip(pieces, found)]

    def _opening(self, pieces: list[str]) -> list[bytes]:
        """The ids of texts' first pieces, which have no blank before them."""
        new = list(set(pieces).difference(self.first))
        own = dict(zip(new, self._ids(new)))
        if len(self.first) < self.most // 16:
            self.first.update((p, ids) for p, ids in own.items() if len(p) <= _LONG)
        return [own[p] if p in own else self.first[p] for p in pieces]

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; together they are not long."""
        if not self.blanks:
            lower = pa.array([t.lower() if t.isascii() else t for t in texts], pa.string())
            marked = pc.replace_substring_regex(pc.replace_substring(lower, "\n", " "), _MARKED, r"\1 \2 ")
            return self._laid(pc.split_pattern(marked, " "))
        odd = [_UNCUT.search(t) is not None or _RUN.search(t) is not None or _SIGN in t for t in texts]
        even = pa.array([t for t, o in zip(texts, odd) if not o], pa.string())
        marked = pc.replace_substring_regex(pc.replace_substring(even, "\n", " \n"), _MARKED, rf"\1 {_SIGN}\2 ")
        plain = iter(self._laid(pc.split_pattern(marked, " ")))
        others = iter(self._laid(pa.array([_CUT.split(t) for t, o in zip(texts, odd) if o], pa.list_(pa.string()))))
        return [next(others if o else plain) for o in odd]

    def _laid(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of texts that are cut into pieces. Arrow numbers the pieces, so that Python sees each different one once,
        and NumPy lays out the ids. The first piece of a text has no blank before it."""
        if not len(cut):
            return []
        coded = cut.flatten().dictionary_encode()
        at, edges, pieces = coded.indices.to_numpy(), cut.offsets.to_numpy(), coded.dictionary.to_pylist()
        ids = self._known(pieces)
        if self.blanks:
            first = edges[:-1]
            ids = ids + self._opening([pieces[k] for k in at[first].tolist()])
            at = at.copy()
            at[first] = len(pieces) + np.arange(len(cut))
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        table, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size, dtype=np.int32) - size
        count = size[at]
        ends = np.cumsum(count, dtype=np.int32)
        flat = table[np.repeat(start[at] - (ends - count), count) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        edge = [0, *(4 * ends[edges[1:] - 1].astype(np.int64)).tolist()]
        return [flat[a:b] for a, b in zip(edge, edge[1:])]

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of a text, cut where it can be; a part but the first begins with its blank."""
        at = 0
        while m := _CUT.search(text, at + _BLOCK):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; a null text has none."""
        if not self.known:
            for text in texts:
                yield self._ids([text or ""])[0]
            return
        marked = [k for k, t in enumerate(texts) if t and any(m in t for m in self.special)]
        if not marked:
            yield from self._plain(texts)
            return
        last = 0
        for k in marked:
            yield from self._plain(texts[last:k])
            text, last = texts[k] or "", k + 1
            between = self._plain(self.parted.split(text))
            yield b"".join(chain(*zip_longest(between, (self.special[m] for m in self.parted.findall(text)), fillvalue=b"")))
        yield from self._plain(texts[last:])

    def _plain(self, texts: list[str | None]) -> Iterator[bytes]:
        """encode_many() of texts without special tokens."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < _BLOCK:
                size += len(texts[end] or "")
                end += 1
            block = [t or "" for t in texts[at:end]]
            if len(block[-1]) > 2 * _BLOCK:
                yield from self._block(block[:-1])
                yield b"".join(self._block([part])[0] for part in self._parts(block[-1]))
            else:
                yield from self._block(block)
            at = end

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, blanks: bool, most: int = KEPT) -> Encoder:
    """One encoder for each Python worker, which keeps so many pieces at most."""
    key = (path, blanks, most)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
