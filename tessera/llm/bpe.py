"""Exact BPE encoding by per-prefix dynamic programming, and decoding (operator 9).

For every prefix of a piece there is exactly one token that can end its BPE encoding.  An automaton
over the vocabulary (a trie with suffix links, which lists at each position all tokens that end
there, longest first) proposes the last token of a prefix; it is accepted if the token pair
(last token of what remains, proposed token) is *compatible*: merging would not cross their border.
Following the stored last tokens back from the end gives the ids, without applying a merge.

Pair compatibility undoes merges from both sides of the border, newest first: if the two tokens
that touch form a vocabulary token whose merge would have come earlier than those undone, BPE would
have taken it and the pair cannot stand.

Around the core this reproduces the public tokenizer file's own pipeline: special strings are cut
out of the raw text first; what lies between is NFC-normalised, lower-cased by character, split by
the file's pattern, mapped to its byte alphabet and ended with ``</w>``.  White space separates
pieces everywhere, so text is cut at white space and the chunks are memoised (bounded).

Defined results: null and empty texts have zero ids; unpaired surrogates cannot occur in Parquet
strings; very long texts and very long words take time in proportion to their length; extra
columns are ignored; repeated rows are encoded row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct as _struct
import unicodedata
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import WordCache, kept, map_rows, table, with_key

#: The vocabulary file of the query; a parameter of every function here.
VOCABULARY = "word_bpe_49k.json"
#: Entries of each memo, twice at most; in the pipeline, whose executors hold more beside it, fewer.
MEMOS, STAGE_MEMOS = 200_000, 100_000
#: Unicode White_Space, which the file's ``\\s`` stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# Letters and numbers that Unicode 16.0 added, which the vocabulary's own library knows
# and this Python's tables may not.
NEW_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Capitals that are newer still, and their small letters.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def category_ranges(letter: str) -> str:
    """The code points of a general category (``L``, ``N``) as the inside of a character class."""
    added = {"L": NEW_LETTERS, "N": NEW_NUMBERS}[letter].split()
    new = {p for r in added for p in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1)}
    out, start = [], None
    for point in range(0x110000 + 1):
        inside = point < 0x110000 and (unicodedata.category(chr(point))[0] == letter or point in new)
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{point - 1:08x}" if point - 1 > start else ""))
            start = None
    return "".join(out)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (public rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PrefixBPE:
    """Encoder over symbols: ``END`` marks a word's last symbol where the vocabulary has word ends."""

    END = "\x00"

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        inner = (lambda t: t[: -len(suffix)] + self.END if t.endswith(suffix) and len(t) > len(suffix) else t) if suffix else (lambda t: t)
        self.word_ends = bool(suffix)
        names = {inner(t): i for t, i in vocabulary.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, (left, right) in enumerate(merges):
            a, b, whole = names[inner(left)], names[inner(right)], names[inner(left + right)]
            self.rank[a, b] = order
            self.parts.setdefault(whole, (a, b, order))
        self.automaton = ahocorasick.Automaton()
        merged = set(self.parts)
        self._compatible: dict[tuple[int, int], bool] = {}
        for name, i in names.items():
            if i in merged and self._makes_itself(i) or i not in merged and len(name.replace(self.END, "")) == 1:
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()

    def _makes_itself(self, token: int) -> bool:
        a, b, order = self.parts[token]
        return self._border_holds(a, b, order)

    def _border_holds(self, left: int, right: int, limit: int) -> bool:
        """No merge of rank under ``limit`` crosses the border while both sides form."""
        rank, parts = self.rank, self.parts
        strict_left = True  # a merge of the same rank further left goes first
        while True:
            across = rank.get((left, right))
            if across is not None and (across < limit or (across == limit and not strict_left)):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                # the left side's last merge is the newer one: undo it
                limit, left, strict_left = a[2], a[1], True
            else:
                # equal ranks form from the left, so the right side's is the newer one
                limit, right, strict_left = b[2], b[0], False

    def compatible(self, left: int, right: int) -> bool:
        known = self._compatible.get((left, right))
        if known is None:
            known = self._border_holds(left, right, 1 << 60)
            if len(self._compatible) > 150_000:
                self._compatible.clear()
            self._compatible[left, right] = known
        return known

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one piece given in the byte alphabet (with ``END`` appended where words end)."""
        n = len(symbols)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        known, compatible = self._compatible, self.compatible
        for end, (token, length) in self.automaton.iter(symbols):
            at = end + 1
            if last[at] >= 0:
                continue
            before = at - length
            if before == 0:
                last[at], size[at] = token, length
                continue
            left = last[before]
            if left >= 0:
                fits = known.get((left, token))
                if fits or fits is None and compatible(left, token):
                    last[at], size[at] = token, length
        out, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no encoding of {symbols!r}")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out


class WordTokenizer:
    """The whole pipeline of a word-end BPE file: special strings, normalisation, pieces, ids, decoding."""

    def __init__(self, path: str, memos: int = MEMOS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = PrefixBPE(model["vocab"], merges, suffix)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.name = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = re.compile(pattern.replace(r"\s", WHITE).replace(r"\p{L}", category_ranges("L")).replace(r"\p{N}", category_ranges("N")))
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet()) if chr(b) != c}
        self.chunks = re.compile(f"[^{WHITE}]+")
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.words = WordCache(self._word, memos)
        self.cache = WordCache(self._chunk, memos)

    def _word(self, piece: str) -> tuple[bytes, bytes]:
        """(ids, token strings) of one piece."""
        # printable ASCII stands for itself in the byte alphabet
        symbols = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
        ids = self.bpe.encode_symbols(symbols + PrefixBPE.END if self.bpe.word_ends else symbols)
        return array("I", ids).tobytes(), " ".join([self.name[i] for i in ids]).encode()

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        if chunk.isascii():
            plain = chunk.lower()
        else:
            # lower() looks at the context of a capital sigma; the file lower-cases single characters
            plain = unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3").lower().translate(NEW_CAPITALS)
        if plain.isascii() and plain.isalpha():
            return self.words[plain]
        parts = [self.words[piece] for piece in self.pieces.findall(plain)]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])

    def _plain(self, text: str) -> list[tuple[bytes, bytes]]:
        # str.split() also cuts at \x1c-\x1f, which are not white space to the file's pattern
        chunks = self.chunks.findall(text) if self.odd_space.search(text) else text.split()
        return list(map(self.cache.__getitem__, chunks))

    def encode_bytes(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8)."""
        text = text or ""
        if self.cut is None or "<|" not in text:
            parts = self._plain(text)
        else:
            parts, at = [], 0
            for found in self.cut.finditer(text):
                parts += self._plain(text[at : found.start()])
                parts.append((_struct.pack("<I", self.special[found[0]]), found[0].encode()))
                at = found.end()
            parts += self._plain(text[at:])
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[0]])

    def encode(self, text: str | None) -> list[int]:
        raw = self.encode_bytes(text)[0]
        return list(_struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: token strings joined by a space, special ones included."""
        return " ".join([self.name[i] for i in ids if i in self.name])


def vocabulary_path(name: str = VOCABULARY) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def tokenizer(vocabulary: str = VOCABULARY, memos: int = MEMOS) -> WordTokenizer:
    """The tokenizer of this worker process, built once."""
    return kept(f"bpe:{vocabulary}:{memos}", lambda: WordTokenizer(vocabulary_path(vocabulary), memos))


def encode_documents(docs: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids, decoded): real ids and decoded text of every row."""

    def kernel():
        tok = tokenizer(vocabulary, STAGE_MEMOS)

        def one(doc_id, text):
            raw, decoded = tok.encode_bytes(text)
            return [(doc_id, len(raw) // 4, np.frombuffer(raw, dtype="<i4"), decoded.decode())]

        return one

    return map_rows(docs, [key, "text"], kernel, with_key(docs, key, "n_tokens long, ids array<int>, decoded string"))


def encode_digests(docs: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the same, digested where it is made."""

    def kernel():
        tok = tokenizer(vocabulary)

        def one(doc_id, text):
            raw, decoded = tok.encode_bytes(text)
            return [(doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest())]

        return one

    return map_rows(docs, [key, "text"], kernel, with_key(docs, key, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: digests of ids and of decoded text for every document."""
    return encode_digests(table(spark, sf_dir, "documents"))
