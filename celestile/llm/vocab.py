"""Encoding with public tokenizers, word by word where that provably changes nothing.

Two families of tokenizers encode a text as the concatenation of its parts:

* ``words``: white space separates and is dropped (a split pattern inverted and
  removed, no part of which matches white space). Any space or line feed is a
  boundary.
* ``gpt2``: byte-level BPE over the GPT-2 pattern. A single space between two
  characters that aren't white space starts a new pre-token, whatever surrounds it:
  the pattern has no look-behind, none of its parts goes on over a space, and
  ``\\s+(?!\\S)`` can't take a lone space before a non-space.

Parts repeat, so their encodings are kept per process, up to ``ROOM`` of them; the
tokenizers library encodes what is missing in one batch. Anything else (another
tokenizer, spaces in a row) goes to the library as it stands.
"""

from __future__ import annotations

import json
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

ROOM = 400_000
MARKS = ".,;:|!?"
#: Letters that every Unicode version calls so, in normal form C, with lower-case forms of their own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"([{_LETTERS}]+)([{MARKS}]?)")
#: Without apostrophes (contractions) and angle brackets (special strings), these letters, digits
#: and marks are pre-tokens by kind.
SIMPLE = re.compile(rf"[{_LETTERS}0-9!-&(-/:;=?@\[-`{{-~]+")
_ENDS = f"([{_LETTERS}])([{MARKS}])( |$)"
SPLIT = {"words": re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+"), "gpt2": re.compile(rf"[{_LETTERS}]+|[0-9]+|[^{_LETTERS}0-9]+")}
_OPEN: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as
    themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_letters()


def opened(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per process."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def _kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    if not plain or spec.get("truncation") or spec.get("padding"):
        return "whole"
    if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "gpt2"
    steps = pre.get("pretokenizers", [])
    if len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
        known = steps[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        local = {json.dumps(n) for n in (norm or {}).get("normalizers", [])} <= {json.dumps(n) for n in ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})}
        if known and local:
            return "words"
    return "whole"


class Encoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = _kind(json.loads(open(path, encoding="utf-8").read()))
        self.model = self.tokenizer.model
        self.lead = BYTES[32] if self.kind == "gpt2" else ""
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.marks = {"": b""} | dict(zip(MARKS, self._library(list(MARKS))))

    def _library(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in out]

    def _simple(self, part: str) -> bytes:
        out, lead = b"", self.lead
        for x in SPLIT[self.kind].findall(part.lower() if self.kind == "words" else part):
            got = self.pieces.get(lead + x)
            if got is None:
                raw = x if x.isascii() else x.encode().decode("latin-1").translate(BYTES)
                got = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(lead + raw)])
                if len(self.pieces) > ROOM // 4:
                    self.pieces.clear()
                self.pieces[lead + x] = got
            out += got
            lead = ""
        return out

    def _fill(self, parts: list[str] | set[str], lead: str) -> None:
        """Encode the parts not known yet; each stands after ``lead``."""
        if len(self.parts) > ROOM // 2:  # what comes up again is taken over from the older half
            self.older, self.parts = self.parts, {}
        known, older, table, tokenize, other = self.parts, self.older, self.bytes_of, self.model.tokenize, []
        head, lower = self.lead, self.kind == "words"
        for p in [p for p in parts if p not in known]:
            got = older.get(p)
            if got is None:
                if p.isascii() and p.isalpha():  # one pre-token in both families
                    got = b"".join([table[t.id] for t in tokenize(head + (p.lower() if lower else p))])
                elif m := PLAIN.fullmatch(p):
                    got = self._stem(m[1]) + self.marks[m[2]]
                elif SIMPLE.fullmatch(p):
                    got = self._simple(p)
                else:
                    other.append(p)
                    continue
            known[p] = got
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            known.update(zip(some, self._library([lead + p for p in some])))

    def _stem(self, stem: str) -> bytes:
        """A Latin word is one pre-token, a lone mark after it another, in both families."""
        got = self.parts.get(stem) or self.older.get(stem)
        if got is None:
            low = stem.lower() if self.kind == "words" else stem
            raw = low if low.isascii() else low.encode().decode("latin-1").translate(BYTES)
            self.parts[stem] = got = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(self.lead + raw)])
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        flat, ends = self.encode_column(pa.array(texts, pa.string()))
        whole, at = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        return [whole[x:y] for x, y in zip(at, at[1:])]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin; the end of all last.
        Texts are cut, numbered and put together in Arrow; only distinct parts are Python's."""
        texts = pc.fill_null(texts, "")
        if self.kind != "words":
            got = self._library(texts.to_pylist())
            return np.frombuffer(b"".join(got), "<u4").astype(np.int32), np.cumsum([0, *(len(x) // 4 for x in got)])
        # Without special strings A-Z can be lowered first, and a mark between a letter and a space is a part.
        texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _ENDS, r"\1 \2\3")
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._fill(kinds, "")
        got = list(map(self.parts.__getitem__, kinds))
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        of_kind = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(got), "<i4")))
        flat = of_kind.take(coded.indices).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(sizes[coded.indices.to_numpy()])]
        return flat, ends[cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """For ``gpt2``: where each part of the text begins, and its number of tokens.
        None if the text isn't plain words with single spaces between."""
        head, *rest = text.split(" ")
        if head[-1:].isspace() or not head and rest:
            return None
        known = set(rest)
        if any(not p or p[0].isspace() or p[-1].isspace() for p in known.difference(self.parts)):
            return None
        self._fill(known, " ")
        sizes = np.fromiter(map(len, map(self.parts.__getitem__, rest)), np.int64, len(rest)) // 4
        first = len(self._library([head])[0]) // 4
        starts = np.cumsum(np.fromiter(map(len, [head, *rest[:-1]]), np.int64, len(rest)) + np.r_[0, np.ones(max(len(rest) - 1, 0), np.int64)]) if rest else np.zeros(0, np.int64)
        return np.r_[0, starts], np.r_[first, sizes]
