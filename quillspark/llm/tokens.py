"""Exact token counts at every prefix, and tokenised pieces.

The tokenizers cut a text at every lone blank or line feed between two other characters
before they look at anything else, so the pieces between such places are encoded apart and
their counts add up: ``count[0] = 0; count[k] = count[k - 1] + tokens(piece k)``. That
table of prefixes answers "how many tokens do the first n characters have" and "how far
does a budget reach" without encoding the text again; inside a piece, a table of the piece's
own prefixes closes the gap, made once for each distinct piece (of at most TABLE_CHARS
characters; a longer word is encoded up to the place asked for). Pieces recur, so that each worker keeps a bounded
cache of them; for byte-level vocabularies, words of letters go through the merges many at a
time, the marks behind them apart. A text with white space of any other kind (several blanks in a
row, tabs, control characters) is cut before each run of white space that follows something else;
the run leads its piece.

Defined results: null texts are empty and have no tokens; texts of any length are counted
whole; repeated rows are counted one by one; an empty table gives an empty table; further
columns are carried through by ``add_counts``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

CACHED_PIECES = 800_000
#: Tables of prefixes inside pieces that are kept, and the longest piece that gets one.
CACHED_TABLES, TABLE_CHARS = 100_000, 64
CHUNK_CHARS = 4_000_000
#: White space other than blanks and line feeds.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Where white space of the tokenizers' own patterns follows anything else.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BEFORE_SPACE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: Letters, then marks: two units of their own for a byte-level vocabulary, whatever surrounds them.
LETTERS = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")
WORDS_AT_ONCE = 1_000


def odd(text: str) -> bool:
    """White space of any kind but the lone blank or line feed that parts two pieces."""
    return (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text) is not None
    )


def byte_letters() -> dict[str, str]:
    """The printable stand-in of each byte in byte-level vocabularies (given as Latin-1)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + k) for k, b in enumerate(others)}


def vocabulary_path(name: str, path: str | None = None) -> str:
    """The vocabulary file: ``path``, or the public one of that name."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes texts piece by piece with a cache; ``blank_leads``: byte-level, a blank belongs to the piece after it."""

    def __init__(self, path: str, blank_leads: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.blank_leads = blank_leads
        self.cache: dict[str, bytes] = {}
        self.within: dict[str, np.ndarray] = {}
        self.stand_in = None
        if blank_leads:  # the same merges for words whose bytes are mapped already
            self.words = Tokenizer.from_file(path)
            feed = byte_letters()["\n"]
            self.words.normalizer, self.words.pre_tokenizer = None, pre_tokenizers.Split(feed, "merged_with_previous")
            # no merge joins a letter and a line feed, so that each word ends with a line feed's id
            self.stand_in, self.feed, self.feed_id = str.maketrans(byte_letters()), feed, self.words.token_to_id(feed)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """The pieces whose ids, joined, are the text's."""
        if not text:
            return []
        if odd(text):
            return BEFORE_SPACE.split(text)
        if not self.blank_leads:
            return text.split()
        # the blank leads its piece, a line feed is a piece of its own
        return text.replace("\n", "\x1f\n\x1f").replace(" ", "\x1f ").split("\x1f")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many in one call."""
        mapped = "\n".join(words).encode().decode("latin-1").translate(self.stand_in).split(self.feed)
        parts = [mapped[k : k + WORDS_AT_ONCE] for k in range(0, len(mapped), WORDS_AT_ONCE)]
        out: list[bytes] = []
        for part, e in zip(parts, self.words.encode_batch_fast([self.feed.join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.feed_id).tolist(), len(ids)]
            assert len(ends) == len(part)
            data, at = ids.tobytes(), 0
            for end in ends:
                out.append(data[4 * at : 4 * end])
                at = end + 1
        return out

    def learn(self, pieces: set[str]) -> None:
        cache = self.cache
        new = pieces.difference(cache)
        if not new:
            return
        if len(cache) + 2 * len(new) > CACHED_PIECES:
            cache.clear()
            new = pieces
        if self.stand_in is not None:
            match = LETTERS.fullmatch
            split = [(p, *m.groups()) for p in new if (m := match(p))]
            words = list({w for _, w, _ in split}.difference(cache))
            cache.update(zip(words, self._encode_words(words) if words else [], strict=True))
            marks = list({x for _, _, x in split}.difference(("",)).difference(cache))
            cache.update(zip(marks, self.encode_many(marks) if marks else [], strict=True))
            cache.update([(p, cache[w] + cache[x]) for p, w, x in split if x])
            new = new.difference(cache)
        rest = list(new)
        cache.update(zip(rest, self.encode_many(rest) if rest else [], strict=True))

    def inside(self, piece: str) -> np.ndarray:
        """Tokens of each prefix of a piece, by its characters; found once for each distinct piece."""
        counts = self.within.get(piece)
        if counts is None:
            if len(self.within) >= CACHED_TABLES:
                self.within.clear()
            ids = self.encode_many([piece[:k] for k in range(1, len(piece) + 1)])
            counts = self.within[piece] = np.array([0, *(len(x) >> 2 for x in ids)], np.int32)
        return counts

    def ids(self, text: str) -> bytes:
        own = self.pieces(text)
        if len(own) == 1:
            return self.encode_many(own)[0]
        self.learn(set(own))
        return b"".join(map(self.cache.__getitem__, own))


@lru_cache(maxsize=4)
def encoder(path: str, blank_leads: bool) -> PieceEncoder:
    return PieceEncoder(path, blank_leads)


def batched(texts: list[str], enc: PieceEncoder) -> Iterator[tuple[int, list[str]]]:
    """Places and pieces of texts, learnt in chunks so that new pieces are encoded many at a time."""
    chunk, size = [], 0
    for k, text in enumerate(texts):
        chunk.append((k, enc.pieces(text)))
        size += len(text)
        if size >= CHUNK_CHARS or k == len(texts) - 1:
            enc.learn(set().union(*[own for _, own in chunk if len(own) != 1]))
            yield from chunk
            chunk, size = [], 0


class PrefixCounts:
    """The table of prefixes of one text: ends[k] characters hold counts[k] tokens."""

    def __init__(self, text: str, enc: PieceEncoder, pieces: list[str] | None = None):
        self.text, self.enc = text, enc
        own = enc.pieces(text) if pieces is None else pieces
        if pieces is None and len(own) != 1:
            enc.learn(set(own))
        if len(own) == 1:
            sizes = [len(enc.encode_many(own)[0]) >> 2]
        else:
            sizes = [x >> 2 for x in map(len, map(enc.cache.__getitem__, own))]
        self.pieces = own
        #: No piece holds the blanks between pieces.
        self.bare = not enc.blank_leads and len(own) > 1 and not odd(text)
        self.counts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))) if own else np.zeros(1, np.int64)

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def ends(self) -> np.ndarray:
        """Characters before and with each piece (without a blank that no piece holds)."""
        if len(self.pieces) == 1:
            return np.array([0, len(self.text)])
        lens = np.cumsum([len(p) for p in self.pieces], dtype=np.int64)
        if self.bare:
            lens += np.arange(len(lens))
        return np.concatenate(([0], lens))

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        ends = self.ends()
        k = int(np.searchsorted(ends, chars, side="right")) - 1
        start = int(ends[k])
        if chars >= len(self.text) or k == len(ends) - 1:
            return self.total
        rest = chars - start
        if self.bare and k:  # a blank that no piece holds
            rest -= 1
        piece = self.pieces[k]
        if rest <= 0:
            return int(self.counts[k])
        if len(piece) <= TABLE_CHARS:
            return int(self.counts[k] + self.enc.inside(piece)[rest])
        return int(self.counts[k]) + (len(self.enc.encode_many([piece[:rest]])[0]) >> 2)

    def reach(self, budget: int) -> int:
        """The most whole pieces' characters that need at most ``budget`` tokens."""
        k = int(np.searchsorted(self.counts, budget, side="right")) - 1
        return int(self.ends()[k])


def add_counts(
    docs: DataFrame, vocabulary: str, blank_leads: bool = False, budget: int = 2048, prefixes: bool = False, text: str = "text", path: str | None = None
) -> DataFrame:
    """Add n_tokens (long) and fit_chars (long: characters of whole pieces within ``budget`` tokens).

    With ``prefixes``, add prefix_chars and prefix_tokens (array<long>), the table itself.
    """
    place = vocabulary_path(vocabulary, path)
    kind = "n_tokens long, fit_chars long" + (", prefix_chars array<bigint>, prefix_tokens array<bigint>" if prefixes else "")

    @F.pandas_udf(kind)
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(place, blank_leads)
        for series in texts:
            values = [x or "" for x in series.tolist()]
            rows = []
            for k, own in batched(values, enc):
                p = PrefixCounts(values[k], enc, own)
                fit = len(values[k]) if p.total <= budget else p.reach(budget)
                rows.append((p.total, fit, *((p.ends(), p.counts) if prefixes else ())))
            columns = ["n_tokens", "fit_chars", *(("prefix_chars", "prefix_tokens") if prefixes else ())]
            yield pd.DataFrame(rows, columns=columns)

    whole = F.coalesce(F.col(text), F.lit("")) if isinstance(text, str) else text
    (own,) = unused(docs, "_c")
    names = [c.split()[0] for c in kind.split(", ")]
    return docs.withColumn(own, count(whole)).select(*[F.col(c) for c in docs.columns if c not in names], f"{own}.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = add_counts(docs, "word_bpe_49k.json", budget=2048)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars"
    )
