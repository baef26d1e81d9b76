"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

The encoder takes at each place the longest vocabulary entry that starts there (all found in one pass of an
Aho-Corasick automaton over the reversed word), keeps it if it may stand beside the entry before it, else tries the
next shorter one, and steps back when none is left; a bit for each place marks dead ends, so no place is tried twice
and time is linear. Two entries may stand beside each other if merging, undone step by step on both sides of their
border, never prefers a pair across it; answers are kept in a table. The result is what merging in rank order gives.

Normalising and pre-tokenising are the vocabulary's own. Decoding gathers bytes by (offset, length) of each id.

Defined cases: null text counts as empty (no ids, empty decoded text); rows are independent, so repeated rows and an
empty table need no rule.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import Encoder, encoder, groups, small, vocabulary

END = 0x400  # added to a character's code where it ends a word


class Backtracking(Encoder):
    """The same ids as Encoder without the library's merging."""

    def __init__(self, path: str):
        super().__init__(path)
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, ids = model["end_of_word_suffix"], model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        form = {t: t if len(t) == 1 else chr(ord(t[0]) + END) for t in ids if t not in made and (len(t) == 1 or t[1:] == suffix)}
        rank = {t: -1 for t in form}
        #: By form: rank, id, halves, next shorter entry that it starts with.
        self.rank: dict[str, int] = dict.fromkeys(form.values(), -1)
        self.id = {form[t]: ids[t] for t in form}
        self.half: dict[str, tuple[str, str]] = {}
        self.pair: dict[tuple[str, str], int] = {}
        for n, (a, b) in enumerate(merges):
            x, y = form[a], form[b]
            self.pair.setdefault((x, y), n)
            if a + b not in rank:
                rank[a + b], form[a + b] = n, x + y
                self.rank[x + y], self.id[x + y], self.half[x + y] = n, ids[a + b], (x, y)
        self.shorter: dict[str, str | None] = {}
        for t in self.rank:
            self.shorter[t] = next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), None)
        self.finder = ahocorasick.Automaton()
        for t in self.rank:
            self.finder.add_word(t[::-1], t)
        self.finder.make_automaton()
        self.beside: dict[tuple[str, str], bool] = {}

    def fits(self, left: str, right: str) -> bool:
        """Whether merging in rank order keeps the border between two entries."""
        key = (left, right)
        if key not in self.beside:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            self.beside[key] = self._fits(left, right)
        return self.beside[key]

    def _fits(self, left: str, right: str) -> bool:
        """Undo the later of the two last merges again and again. A pair across the border that ranks before the merge
        undone last would have been taken first; at equal rank the leftmost pair goes first."""
        rank, last = self.rank, float("inf")
        while True:
            across = self.pair.get((left, right))
            if across is not None and across < last:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                last, left = a, self.half[left][1]
            else:  # the right side's merge lies to the right, so a pair across of the same rank goes before it
                last, right = b + 1, self.half[right][0]

    def word(self, w: str) -> list[int]:
        """The ids of one pre-token, whose last character is marked."""
        if w in self.id:
            return [self.id[w]]
        n = len(w)
        longest: list[str | None] = [None] * n
        for end, t in self.finder.iter(w[::-1]):
            start = n - 1 - end
            if longest[start] is None or len(t) > len(longest[start]):
                longest[start] = t
        out: list[str] = []
        alive, at, t = [True] * (n + 1), 0, longest[0]
        while at < n:
            before = out[-1] if out else None
            while t is not None:
                if alive[at + len(t)] and (before is None or self.fits(before, t)):
                    break
                t = self.shorter[t]
            if t is None:
                alive[at] = False
                t = out.pop()
                at -= len(t)
            else:
                out.append(t)
                at += len(t)
                t = longest[at] if at < n else None
        return [self.id[t] for t in out]

    def words(self, words: list[str]) -> list[list[int]]:
        return [self.marked(w.translate(self.letters)) for w in words]

    def marked(self, w: str) -> list[int]:
        """The ids of one pre-token."""
        return self.word(w[:-1] + chr(ord(w[-1]) + END))

    def piece(self, text: str) -> np.ndarray:
        """The ids of any text: special tokens first, then the pre-tokens between them."""
        out, at = [], 0
        for m in [*self.cut.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                out += self.marked(w)
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return np.array(out, "<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return list(map(self.piece, texts))


class Table:
    """Byte strings by id, each found by offset and length."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.bytes[np.repeat(self.offset[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def sha256(self, ids: np.ndarray, most: int = 1 << 18) -> str:
        """The digest of the strings of ids on end, without the last byte, which is a separator; `most` ids at a time."""
        out = hashlib.sha256()
        for a in range(0, len(ids), most):
            part = self(ids[a : a + most])
            out.update(part if a + most < len(ids) else part[:-1])
        return out.hexdigest()


def tables(library: object) -> tuple[Table, Table]:
    """Of decimal numbers, and of what ids decode to: without a decoder, entries stand apart by one space."""
    names = [(library.id_to_token(i) or "").encode() + b" " for i in range(library.get_vocab_size())]
    return Table([b"%d " % i for i in range(len(names))]), Table(names)


def op5_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, Backtracking)
        if not hasattr(encode, "tables"):
            encode.tables = tables(encode.library)
        decimal, decoded = encode.tables
        for batch in small(batches):
            n, sums, texts = [], [], []
            for _, run in groups(batch):
                for ids in encode(run):
                    n.append(len(ids))
                    sums.append(decimal.sha256(ids))
                    texts.append(decoded.sha256(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
