"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch it.

A leaf holds up to LEAF pre-tokens and the sum of their token counts; inner nodes hold the sums of their
children. Trees are tables: one row per document with its leaves' texts and counts, from which an edit job
reads them, not the texts. The pre-token pattern looks only to the right, so matching may restart at any old
boundary. For an edit the leaves it touches and the two before are matched again, with the text that follows
as context, on to where a new boundary falls on an old leaf's; what was matched is cut into leaves again.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.llm.common import match_spans, stored

LEAF = 32
CACHED = 300_000
EDITS = "array<struct<start:int,end:int,replacement:string>>"
#: Of the query: mail addresses and long digit runs are masked.
MASKED = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|[0-9]{4,}"


@lru_cache(maxsize=2)
def _library(ranks: str, pattern: str):
    import regex
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return regex.compile(pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), table, {}


class Counter:
    """Token counts of pre-tokens; a bounded number of them is kept."""

    def __init__(self, ranks: str, pattern: str):
        self.pattern, self.encoding, self.table, self.kept = _library(ranks, pattern)

    def __call__(self, token: str) -> int:
        n = self.kept.get(token)
        if n is None:
            raw = token.encode()
            n = 1 if raw in self.table else len(self.encoding.encode_single_piece(raw) if hasattr(self.encoding, "encode_single_piece") else self.encoding._encode_single_piece(raw))
            if len(self.kept) < CACHED:
                self.kept[token] = n
        return n

    def leaves(self, text: str) -> tuple[list[str], list[int]]:
        return self.grouped(self.pattern.findall(text))

    def grouped(self, tokens: list[str]) -> tuple[list[str], list[int]]:
        groups = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)]
        return ["".join(g) for g in groups], [sum(map(self, g)) for g in groups]


class TokenTree:
    """The pre-token segment tree of one text, from the text or from stored leaves. Slots may be blank after edits."""

    def __init__(self, counter: Counter, texts: list[str], counts: list[int]):
        self.counter, self.encoded = counter, 0
        self._index(texts, counts)

    @classmethod
    def of(cls, text: str, counter: Counter) -> TokenTree:
        return cls(counter, *counter.leaves(text))

    def _index(self, texts: list[str], counts: list[int]) -> None:
        self.texts = texts
        self.size = 1 << max(0, len(counts) - 1).bit_length()
        self.sums = [0] * self.size + counts + [0] * (self.size - len(counts))
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1] if self.texts else 0

    def leaves(self) -> tuple[list[str], list[int]]:
        """Texts and counts of the leaves that aren't blank."""
        held = [(t, n) for t, n in zip(self.texts, self.sums[self.size :]) if t]
        return [t for t, _ in held], [n for _, n in held]

    def _set(self, slot: int, text: str, count: int) -> None:
        self.texts[slot] = text
        i = slot + self.size
        change = count - self.sums[i]
        while change and i:
            self.sums[i] += change
            i >>= 1

    def _replace(self, first: int, final: int, texts: list[str], counts: list[int]) -> None:
        """New leaves in the slots first to final: set one by one where they fit, else the tree is indexed again."""
        room = final - first + 1
        if len(texts) <= room:
            for k in range(room):
                self._set(first + k, texts[k] if k < len(texts) else "", counts[k] if k < len(texts) else 0)
        else:
            old = self.sums[self.size : self.size + len(self.texts)]
            self._index(self.texts[:first] + texts + self.texts[final + 1 :], old[:first] + counts + old[final + 1 :])

    def _before(self, slot: int, n: int) -> int:
        """The n-th slot before that isn't blank, or the first."""
        while slot > 0 and n:
            slot -= 1
            n -= self.texts[slot] != ""
        return slot

    def _after(self, slot: int, n: int) -> int:
        """Like ``_before``, to the right; the number of slots where there are fewer."""
        while slot < len(self.texts) - 1 and n:
            slot += 1
            n -= self.texts[slot] != ""
        return slot if not n else len(self.texts)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, replacement), ascending and disjoint, in places of the text before them."""
        if not any(self.texts):
            self._index(*self.counter.leaves("".join(r for _, _, r in edits)))
            return
        ends = list(accumulate(map(len, self.texts)))
        last = max(i for i, t in enumerate(self.texts) if t)
        slot = lambda place: min(bisect_right(ends, place), last)
        # From the right to the left, so the slots of edits to come keep their numbers.
        todo = list(edits)
        while todo:
            final = slot(max(todo[-1][0], todo[-1][1] - 1))
            first, inside = self._before(slot(todo[-1][0]), 2), [todo.pop()]
            # Edits in the region, or so near that they would be its context, join in.
            while todo and self._after(slot(max(todo[-1][0], todo[-1][1] - 1)), 3) >= first:
                first = min(first, self._before(slot(todo[-1][0]), 2))
                inside.append(todo.pop())
            begin = ends[first - 1] if first else 0
            while True:
                text = _edited("".join(self.texts[first : final + 1]), begin, inside[::-1])
                context = self._after(final, 2)
                tokens, at = [], 0
                for m in self.counter.pattern.finditer(text + "".join(self.texts[final + 1 : context + 1])):
                    if at >= len(text):
                        break
                    tokens.append(m.group())
                    at = m.end()
                if at <= len(text) or context >= len(self.texts) and final >= last:
                    break
                final = min(self._after(final, 1), len(self.texts) - 1)
            self.encoded += sum(t != "" for t in self.texts[first : final + 1])
            self._replace(first, final, *self.counter.grouped(tokens))


def _edited(text: str, begin: int, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at : start - begin], new]
        at = end - begin
    return "".join([*out, text[at:]])


TREES = "doc_id long, leaves array<string>, counts array<int>"


def token_trees(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, leaves, counts, and ``edits`` if docs has it) per row of docs: the trees, to be stored as a table.

    Null and empty texts have trees without leaves. Rows are treated one by one: repeats, ties and null ids are
    of no account, very long texts are cut whole, and other columns are left out. No rows give no trees.
    """
    edited = "edits" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            made = [counter.leaves(t.as_py() or "") for t in batch.column("text")]
            cols = [batch.column("doc_id"), pa.array([t for t, _ in made], pa.list_(pa.string())), pa.array([n for _, n in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols + ([batch.column("edits")] if edited else []), ["doc_id", "leaves", "counts"] + ["edits"] * edited)

    rows = docs.select("doc_id", "text", *[F.col("edits").cast(EDITS).alias("edits")] * edited)
    return rows.mapInArrow(run, TREES + (f", edits {EDITS}" if edited else ""))


def apply_edits(trees: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Trees (doc_id, leaves, counts, edits) after their edits, with n_tokens and n_leaves before them, n_edits, n_tokens_after and leaves_encoded_again.

    ``edits`` are ascending and disjoint spans in code points with their replacements; null means none, and
    a null replacement is empty. Rows are treated one by one, from their leaves alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                edits = [(e["start"], e["end"], e["replacement"] or "") for e in batch.column("edits")[i].as_py() or []]
                counts = batch.column("counts")[i].as_py()
                before, again = sum(counts), 0
                texts = batch.column("leaves")[i].as_py()
                n_leaves = len(texts)
                if edits:
                    tree = TokenTree(counter, texts, counts)
                    tree.apply(edits)
                    (texts, counts), again = tree.leaves(), tree.encoded
                for col, value in zip(cols, (texts, counts, before, n_leaves, len(edits), sum(counts), again)):
                    col.append(value)
            types = (pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", "leaves", "counts", "n_tokens", "n_leaves", "n_edits", "n_tokens_after", "leaves_encoded_again"])

    return trees.select("doc_id", "leaves", "counts", "edits").mapInArrow(run, TREES + ", n_tokens long, n_leaves long, n_edits long, n_tokens_after long, leaves_encoded_again long")


def count_tokens(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_leaves, leaves_encoded_again) per row of docs (doc_id, text, edits).

    The trees are stored first; the edits work on what is read back. Rows as in ``token_trees`` and ``apply_edits``.
    """
    edited = apply_edits(stored(token_trees(docs, ranks, pattern), "trees"), ranks, pattern)
    return edited.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_leaves", "leaves_encoded_again")


def masks(text: Column, pattern: str = MASKED, replacement: str = "<masked>") -> Column:
    """Edits that put ``replacement`` for every match."""
    spans = match_spans(F.coalesce(text, F.lit("")), pattern)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(replacement).alias("replacement")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", masks(F.col("text")).alias("edits"))
    return count_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
