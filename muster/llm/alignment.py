"""Alignment of two tokenizers' tokens over the same bytes.

Every byte of a text gets a label: no token ends after it, one of tokenizer A
does, one of B, or both.  A regular expression scans the string of labels and
takes spans up to each label "both"; the labels that it counts in a span tell
how many tokens of A and of B form that group.  Within a group no inner end is
shared, so a group of i and j tokens has i + j - 1 overlapping pairs (links),
which a walk along its labels lists.

A is a byte-level BPE (tokenizers), which gets a space and the text; B is a BPE
of pieces with byte fallback (sentencepiece), which adds that space itself.
Both may be given a text in parts that are cut before a single space between
two other characters: such a space always starts a pre-token of A's pattern,
and no piece of B has a space after another character, which is checked when
the model is loaded.  So tokens of a part are the tokens in the text, each part
ends a group, and parts (words, mostly) are aligned once and remembered.

Corpus counts: a pair of ids counts once for each document (row) that holds it
linked.  Documents keep their distinct pairs; the pairs that most rows hold,
of which there can be HOT at most, go to the rows by broadcast, all others meet
their counts in a shuffle where no key has more than one HOT-th of the rows.

Defined results: null and empty texts, and texts whose tokens of A or of B do
not spell a space and the text, have no tokens, groups or links.  Strings of
special tokens are plain text.  Repeated rows count each; columns besides id
and text are never looked at.  An empty table gives an empty result.  Both files
must be at the same path on every machine.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm.store import small_batches, stored

# a task has one core; the library's own threads would cost memory and time
os.environ["TOKENIZERS_PARALLELISM"] = "false"
#: Parts in each of the two generations that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 100_000, 64
#: New parts that are aligned at once.
TOGETHER = 4096
#: Pairs of ids that are broadcast: those that more than one in so many of all rows of pairs hold, so fewer than that.
HOT = 1 << 17
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Labels of a byte: tokens of A and of B that end after it.
END_A, END_B = 1, 2
#: A group: up to the next byte after which both end.
GROUP = re.compile(rb"[\x00-\x02]*\x03")
B_BITS = 32


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _names(n: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(n)], object)


class Aligner:
    """Tokens of parts of texts by both tokenizers, their groups and links; lately used parts are remembered.

    What is known of a part is (tokens of A, groups as text, links as bytes of 64-bit
    integers a << 32 | b), or None where tokens do not spell the part.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        if self.a.normalizer is not None or "ByteLevel" not in repr(self.a.pre_tokenizer):
            raise ValueError(f"{path_a} is no plain byte-level tokenizer, for which the places of cuts are proven")
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = _byte_letters()
        # added tokens are plain text here and have no letters
        self.bytes_a = {i: bytes(map(letters.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces with a space after another character, for which the places of cuts are not proven")
        self.bytes_b = dict(enumerate(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)))
        most = 1 + max(self.bytes_a)
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(most)])
        self.size_b = np.array([len(self.bytes_b[i]) for i in range(len(pieces))])
        # ids as they are written inside a group, at the end of its tokens of A, of the group, and of the part
        self.names_a = {end: _names(most, end) for end in ",|"}
        self.names_b = {end: _names(len(pieces), end) for end in ",;\n"}
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Aligns the parts of ``texts`` that are not remembered."""
        young, old, fresh = self.young, self.old, []
        for p in set().union(*texts):
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    fresh.append(p)
        # a part at the end of a text may end in white space, where the next one is not proven to start a token
        inner = [p for p in fresh if not p[-1].isspace()]
        for k in range(0, len(inner), TOGETHER):
            self._learn(inner[k : k + TOGETHER])
        for p in fresh:
            if p[-1].isspace():
                self._learn([p])

    def _learn(self, parts: list[str]) -> None:
        """Aligns ``parts`` as one text; if its tokens do not spell it, in halves."""
        found = self.aligned(parts)
        if found is not None:
            self.young.update(zip(parts, found))
        elif len(parts) == 1:
            self.young[parts[0]] = None
        else:
            half = len(parts) // 2
            self._learn(parts[:half])
            self._learn(parts[half:])

    def forget(self) -> None:
        if len(self.young) > REMEMBERED:
            self.old, self.young = {p: x for p, x in self.young.items() if len(p) <= LONGEST}, {}

    def aligned(self, parts: list[str]) -> list[tuple[int, str, bytes]] | None:
        """What is to be known of each of ``parts``, which make up one text; None if its tokens do not spell it."""
        text = "".join(parts)
        a, b = np.array(self.a.encode(text, add_special_tokens=False).ids), np.array(self.b.encode(text[1:], num_threads=1))
        raw = text.encode()
        if not len(b) or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        end_a, end_b = np.cumsum(self.size_a[a]) - 1, np.cumsum(self.size_b[b]) - 1
        part_end = np.cumsum([len(p.encode()) for p in parts]) - 1
        labels = np.zeros(len(raw), np.uint8)
        labels[end_a] = END_A
        labels[end_b] |= END_B
        group_end = np.array([m.end() for m in GROUP.finditer(labels.tobytes())]) - 1
        # after each end the token of that side is over: pairs are those of the tokens that end there or go on
        ends = np.flatnonzero(labels)
        seen_a, seen_b = (np.cumsum((labels[ends] & side) > 0) - ((labels[ends] & side) > 0) for side in (END_A, END_B))
        links = ((a[seen_a] << B_BITS) | b[seen_b]).tobytes()
        link_cut = np.searchsorted(ends, part_end, "right") * 8
        token_cut = np.searchsorted(end_a, part_end, "right")
        # ids in the order of groups, those of A first in each
        of_a, of_b = np.searchsorted(group_end, end_a), np.searchsorted(group_end, end_b)
        last_b, closes = group_end[of_b] == end_b, np.isin(end_b, part_end)
        written = np.concatenate([
            np.where(group_end[of_a] == end_a, self.names_a["|"][a], self.names_a[","][a]),
            np.where(closes, self.names_b["\n"][b], np.where(last_b, self.names_b[";"][b], self.names_b[","][b])),
        ])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        groups = "".join(written[order].tolist()).split("\n")
        counts, cuts = np.diff(token_cut, prepend=0).tolist(), [0, *link_cut.tolist()]
        return [(n, g, links[x:y]) for n, g, x, y in zip(counts, groups, cuts, cuts[1:])]


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_TYPE = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"


def aligned(text: Column, path_a: str, path_b: str) -> Column:
    """struct(n_a, n_b, n_groups, n_links, groups, pairs, times).

    ``groups`` is written as ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct
    links, in order, each as a << 32 | b, and ``times`` how often they stand in the text.
    """

    @F.arrow_udf(_TYPE)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _aligner(path_a, path_b)
        for col in batches:
            out: list[tuple] = []
            for lo in range(0, len(col), 64):  # so many documents' parts are looked up at once
                texts = [_CUT.split(f" {t}") if (t := x.as_py()) else [] for x in col[lo : lo + 64]]
                aligner.learn(texts)
                for parts in texts:
                    found = list(map(aligner.young.__getitem__, parts))
                    out.append(joined(found) if None not in found else joined([]))
                aligner.forget()
            counts, groups, pairs, times = ([x[k] for x in out] for k in range(4))
            ends = pa.array(np.cumsum([0, *map(len, pairs)], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))) for x, t in ((pairs, np.int64), (times, np.int32))]
            columns = np.array(counts, np.int64).reshape(-1, 4).T
            yield pa.StructArray.from_arrays([*map(pa.array, np.ascontiguousarray(columns)), pa.array(groups, pa.string()), *lists],
                                             ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return align(text)


def joined(parts: list[tuple[int, str, bytes]]) -> tuple[tuple, str, np.ndarray, np.ndarray]:
    """Numbers of tokens, groups and links, the groups as text, distinct links and how often they stand, of a text's parts."""
    if not parts:
        return (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens, groups, links = zip(*parts)
    text, every = ";".join(groups), np.frombuffer(b"".join(links), np.int64)
    n_a, n_groups = sum(tokens), text.count(";") + 1
    return (n_a, len(every) + n_groups - n_a, n_groups, len(every)), text, *np.unique(every, return_counts=True)


def with_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups, pairs and times (see ``aligned``); columns of those names are replaced."""
    small_batches(docs.sparkSession)
    new = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return docs.select(*own, aligned(F.col("text"), path_a, path_b).alias("__found")).select(*own, *[f"__found.{c}" for c in new])


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (rows that hold it), best (whether no pair of the same id of A has more) of rows with ``pairs``."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", B_BITS)))  # an id of A meets B's vocabulary at most
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def link_scores(found: DataFrame) -> DataFrame:
    """row, n_best, count_sum for ``found`` (row, pairs, times; stored; ``row`` tells rows apart).

    count_sum adds up the corpus count of every link, n_best counts links whose
    count is the highest of their id of A.
    """
    counts = stored(pair_counts(found), "counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * HOT > rows
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    hot = F.broadcast(counts.where(frequent))  # fewer than HOT of them, as their counts add up to the rows
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    parts = [each.join(hot, "pair"), each.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~frequent), "pair")]
    both = [p.groupBy("row").agg(*sums) for p in parts]
    return both[0].unionByName(both[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
