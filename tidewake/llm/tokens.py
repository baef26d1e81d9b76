"""Token ids of whole texts: those of their words, which are looked up many at once or handed to the tokenizers library.

The vocabulary's normaliser turns each run of white space into one space and its pre-tokeniser never joins what white
space separates, so a text's ids are those of its pieces in order. Plain texts and pieces (see wordtable.py) go through
the worker's word table; other pieces are encoded whole and kept, up to KEPT characters and ids in all. Texts with
U+001C to U+001F, which Python takes for white space and the library does not, are encoded as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .wordtable import PLAIN, WordTable

#: Characters and ids of pieces that are kept, and characters of the longest one.
KEPT, LONGEST = 4_000_000, 100
ODD = re.compile("[\x1c-\x1f]")
_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to arrays of ids (little-endian unsigned 32-bit)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: n for n, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        #: What the byte-level pre-tokeniser makes of each letter outside ASCII.
        self.letters = {c: self.library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.table = WordTable(self.words)
        self.known: dict[str, np.ndarray] = {}
        self.kept = 0

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of plain words, by the library's model alone: they need no normalising and no splitting."""
        model = self.library.model.tokenize
        return [[t.id for t in model(w.translate(self.letters))] for w in words]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not self.cut.search(text)

    def pieces(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """The ids of each piece that is not plain."""
        known = {p: self.known.get(p) for p in pieces}
        new = [p for p, ids in known.items() if ids is None]
        for p, ids in zip(new, self.whole(new), strict=True):
            known[p] = ids
            if len(p) <= LONGEST:
                if self.kept > KEPT:
                    self.known.clear()
                    self.kept = 0
                self.known[p] = ids
                self.kept += len(p) + len(ids) + 40
        return known

    def mixed(self, text: str) -> np.ndarray:
        """The ids of a text by its pieces; runs of plain ones are one text to the word table."""
        runs: list[list[str]] = [[]]
        hard: list[str] = []
        for p in text.split():
            if self.plain(p):
                runs[-1].append(p)
            else:
                hard.append(p)
                runs.append([])
        easy, known = self.table([" ".join(r) for r in runs]), self.pieces(hard)
        return np.concatenate([easy[0], *(part for p, run in zip(hard, easy[1:], strict=True) for part in (known[p], run))])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.plain(t) for t in texts]
        odd = [not p and ODD.search(t) is not None for p, t in zip(plain, texts, strict=True)]
        easy = iter(self.table([t for t, p in zip(texts, plain, strict=True) if p]))
        hard = iter(self.whole([t for t, o in zip(texts, odd, strict=True) if o]))
        return [next(easy) if p else next(hard) if o else self.mixed(t) for t, p, o in zip(texts, plain, odd, strict=True)]


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """The worker's own encoder, made once."""
    key = f"{kind.__name__}:{path}"
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]


def groups(batch: pa.RecordBatch, most: int = 300_000) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch (null: empty) in runs of about `most` characters, each with the place of its first row."""
    first, run, size = 0, [], 0
    for k, text in enumerate(batch.column("text")):
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= most:
            yield first, run
            first, run, size = k + 1, [], 0
    if run:
        yield first, run


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what is made of a batch stays small. Spark bounds batches by bytes."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def ordered_parts(docs, n: int) -> list[int]:
    """The ids at which at most n - 1 of n ranges of doc_id begin, with about as many rows each; from all rows, by a mergeable sketch."""
    from pyspark.sql import functions as F

    at = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), 10_000).alias("q")).first()["q"] if at else []
    return sorted(set(found or []))
