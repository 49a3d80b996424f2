"""Token ids of whole texts by a public tokenizer, and their counts by overlap resynchronisation.

Ids: words are encoded by the library's model and remembered in a bounded table, as words repeat, where the tokenizer
file has the rules that WordIds knows; with any other file, whole texts go to the library.

Counts: a text is cut into chunks that overlap. The library encodes each with offsets, and two neighbours are spliced at a
stable boundary that both have; where the overlap has none, it is widened. A text of one chunk is a case of this.
Tests hold the results against whole texts given to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import Struct, pack

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm.common import Scratch, keyed, slices, texts_of

#: Pieces that a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Characters of a chunk without its overlap, and of the first overlap.
CHUNK, OVERLAP = 1 << 13, 256


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


class Memory(dict):
    """What `make(piece)` gives for each piece; holds at most two generations of `most` pieces."""

    def __init__(self, make: Callable[[bytes], object], most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: bytes):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


#: For str.translate of a text that was decoded as Latin-1, byte by byte.
_LETTERS = dict(enumerate(_byte_letters()))

# Letters of ASCII and of U+00C0 to U+00FF; ASCII marks but ' (contractions) and < (special tokens). Of such words the
# pre-tokens are plain: runs of letters, runs of marks, and digits.
_L, _M = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])", rb"[!-&(-/:;=-@\[-`{-~]"
_LETTERS_ONLY, _MARKS_1 = re.compile(_L + rb"+"), frozenset(bytes([b]) for b in range(33, 127) if re.fullmatch(_M, bytes([b])))
_WORD = re.compile(rb"(?:%b|[0-9]|%b)+" % (_L, _M))
_WORD_PARTS = re.compile(rb"%b+|[0-9]|%b+" % (_L, _M))
_PIECE = re.compile(rb"(?:%b|[0-9]|%b)+(?:\n(?:%b|[0-9]|%b)+)*" % (_L, _M, _L, _M))
_PIECE_PARTS = re.compile(rb"%b+|[0-9]+|%b+|\n" % (_L, _M))


_LITTLE = [Struct("<%dI" % n).pack for n in range(32)]


#: The rules of tokenizer files whose ids are those of the words, one by one.
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


class WordIds:
    """Ids of texts by a tokenizer whose pre-tokenizer drops white space, lower-cases, and cuts letters from marks.

    White space parts pre-tokens there, so that the ids of a text are those of its ASCII-white-space words in turn. A file
    of other rules than those gets whole texts.
    """

    def __init__(self, path: str):
        lib = self.lib = tokenizer(path)
        model = lib.model
        rules = json.loads(lib.to_str())
        self.by_word = all(rules.get(k) == v for k, v in _WORD_RULES.items()) and all(t["content"].strip() == t["content"] and " " not in t["content"] for t in rules["added_tokens"])

        def encode(word: bytes) -> bytes:
            if word.isalpha():  # ASCII letters stand for themselves
                low = word.lower()
                if low != word:
                    return self.words[low]
                ids = [t.id for t in model.tokenize(word.decode())]
            elif word[-1:] in _MARKS_1 and _LETTERS_ONLY.fullmatch(word, 0, len(word) - 1):
                return self.words[word[:-1]] + self.words[word[-1:]]
            elif _LETTERS_ONLY.fullmatch(word):
                low = word.decode().lower().encode()
                if low != word:
                    return self.words[low]
                ids = [t.id for t in model.tokenize(low.decode("latin-1").translate(_LETTERS))]
            elif _WORD.fullmatch(word):
                low = word.decode().lower().encode()
                ids = [t.id for p in _WORD_PARTS.findall(low) for t in model.tokenize(p.decode("latin-1").translate(_LETTERS))]
            else:
                ids = lib.encode(word.decode(), add_special_tokens=False).ids
            return _LITTLE[len(ids)](*ids) if len(ids) < len(_LITTLE) else pack("<%dI" % len(ids), *ids)

        self.words = Memory(encode)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [pack(f"<{len(e.ids)}I", *e.ids) for e in self.lib.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def boundaries(lib, text: str) -> tuple[list[tuple[int, int]], int]:
    """((character, number of tokens before it) at the start of each pre-token), and the number of tokens."""
    e = lib.encode(text, add_special_tokens=False)
    ids, offsets = e.word_ids, e.offsets
    return [(offsets[k][0], k) for k in range(len(ids)) if k == 0 or ids[k] is None or ids[k - 1] is None or ids[k] != ids[k - 1]], len(ids)


#: Characters at a chunk's end where a longer text could change pre-tokens: a special token may be cut there.
MARGIN = 32


def splice(left: list[tuple[int, int]], left_end: int, right: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """A stable common boundary of two overlapping chunks, or None: (character, tokens before it in left, in right).

    Pre-tokens are found from left to right without looking back. A boundary of the left chunk, but for its last
    pre-token and MARGIN characters, is one of the whole text. Where the right chunk has it too, both go on alike.
    """
    own = dict(right)
    safe = min(left_end - MARGIN, left[-1][0] if left else 0)
    for at, k in reversed(left):
        if at <= safe and at in own:
            return at, k, own[at]
    return None


def chunk_bounds(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    return [(s, min(n, s + chunk + overlap)) for s in range(0, n, chunk)] or [(0, 0)]


def count_spliced(lib, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text, one chunk in memory at a time; an overlap without a stable boundary is doubled."""
    total, start, n = 0, 0, len(text)
    spans = iter(chunk_bounds(n, chunk, overlap)[1:])
    left, size = boundaries(lib, text[start : min(n, chunk + overlap)])
    end, done = min(n, chunk + overlap), 0  # tokens of the current chunk that are counted already
    for s, e in spans:
        wide = overlap
        while True:
            right, right_size = boundaries(lib, text[s:e])
            at = splice([(c + start, k) for c, k in left if c + start >= s], end, [(c + s, k) for c, k in right])
            if at:
                total += at[1] - done
                left, size, start, end, done = right, right_size, s, e, at[2]
                break
            if end >= n:  # the current chunk reaches the end of the text by itself
                return total + size - done
            wide *= 2
            end = min(n, end + wide)
            left, size = boundaries(lib, text[start:end])
            e = max(e, min(n, end + overlap))
    return total + size - done


def summary(lib, chunk: str, start: int, head: int, tail: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], int]:
    """(tokens, boundaries in the first `head` characters, those from character `tail` on, the last boundary).

    Boundaries as `boundaries` has them, in characters of the whole text; tokens are looked at one by one from either end.
    """
    e = lib.encode(chunk, add_special_tokens=False)
    n, ids = len(e), e.word_ids
    new = lambda k: k == 0 or ids[k] is None or ids[k - 1] is None or ids[k] != ids[k - 1]
    place = lambda k: e.token_to_chars(k)[0]
    front, back, last = [], [], start
    for k in range(n):
        if place(k) >= head:
            break
        if new(k):
            front.append((start + place(k), k))
    for k in range(n - 1, -1, -1):
        at = place(k)
        if new(k):
            last = max(last, start + at)
            if at >= tail:
                back.append((start + at, k))
        if at < tail and last > start:
            break
    return n, front, back[::-1], last


_COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_LONG = "row_key long, s long, chunk string"
_SUMMARY = "row_key long, s long, e long, tokens long, head array<struct<at:long,k:long>>, tail array<struct<at:long,k:long>>, last long"


def counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document; null text is empty, rows are judged one by one.

    A text of one chunk is encoded where it is read. Chunks of longer texts are rows that Spark deals out, so that one text
    keeps many tasks busy; summaries of their overlaps alone return, to be spliced per document.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")
    docs = keyed(docs, scratch)
    long = F.char_length("text") > CHUNK
    names = [x.split()[0] for x in _COUNT_SCHEMA.split(", ")]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(path)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            n = [len(e) for a, b in slices(texts) for e in lib.encode_batch_fast([t.decode() for t in texts[a:b]], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = range(0, len(text), CHUNK)
                for a in range(0, len(at), 64):
                    some = at[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([text[s : s + CHUNK + OVERLAP] for s in some])], names=["row_key", "s", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(path)
        for batch in batches:
            out = []
            for key, s, chunk in zip(*(batch.column(c).to_pylist() for c in ("row_key", "s", "chunk")), strict=True):
                n, front, back, last = summary(lib, chunk, s, OVERLAP, CHUNK)
                out.append((key, s, s + len(chunk), n, *([{"at": at, "k": k} for at, k in x] for x in (front, back)), last))
            types = (*[pa.int64()] * 4, _MARKS, _MARKS, pa.int64())
            cols = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row_key", "s", "e", "tokens", "head", "tail", "last"])

    @F.pandas_udf("long")
    def spliced(column: pd.Series) -> pd.Series:
        return pd.Series([_splice_parts(p) for p in column], dtype="Int64")

    @F.pandas_udf("long")
    def widened(column: pd.Series) -> pd.Series:
        return pd.Series([count_spliced(tokenizer(path), t, CHUNK, 2 * OVERLAP) for t in column], dtype="int64")

    one = docs.where(~long).select("doc_id", "text").mapInArrow(plain, _COUNT_SCHEMA)
    parts = docs.where(long).select("row_key", "text").mapInArrow(cut, _LONG).repartition("row_key", "s").mapInArrow(encode, _SUMMARY)
    per_doc = parts.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("s", "e", "tokens", "head", "tail", "last"))).alias("parts"))
    found = scratch.write(per_doc.select("row_key", spliced("parts").alias("n_tokens")), "spliced")
    # A pair of chunks without a stable common boundary sends its text through wider overlaps.
    failed = scratch.write(docs.join(found.where("n_tokens IS NULL").select("row_key"), "row_key", "left_semi").select("row_key", widened("text").alias("n_tokens")), "widened")
    many = found.where("n_tokens IS NOT NULL").unionByName(failed)
    sized = docs.where(long).select("row_key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    many = sized.join(many, "row_key").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return one.unionByName(many)


_MARKS = pa.list_(pa.struct([("at", pa.int64()), ("k", pa.int64())]))


def _splice_parts(parts) -> int | None:
    """Tokens of a text from its chunks' summaries in order; None if some pair has no stable common boundary."""
    total, done, this = 0, 0, parts[0]
    for nxt in parts[1:]:
        tail = [(m["at"], m["k"]) for m in this["tail"]]
        safe = min(this["e"] - MARGIN, this["last"])
        own = {m["at"]: m["k"] for m in nxt["head"]}
        at = next(((k, own[c]) for c, k in reversed(tail) if c <= safe and c in own), None)
        if at is None:
            return None
        total += at[0] - done
        this, done = nxt, at[1]
    return total + this["tokens"] - done
