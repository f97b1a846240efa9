"""Near-duplicates by 64-bit fingerprints of word shingles.

Fingerprints within ``DISTANCE`` = 4 bits differ in at most four of their eight bytes, so they
share at least four bytes at the same position: the guaranteed minimum.  An inverted index over
single bytes has only 2,048 entries; the index here is keyed by three positions and their bytes.
The twenty triples of ``TRIPLES`` hit every choice of four positions, so every pair that reaches
the minimum meets under a key.  Pairs that meet have their shared positional bytes tallied, those
below the minimum are left out, and the rest is verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import quoted
from corpusloom.llm.common import attach, batches, rows_of, utf8
from corpusloom.llm.components import components
from corpusloom.operators.scratch import settle

SHINGLE = 4
DISTANCE = 4
SEED = 42
SHARED = 8 - DISTANCE
#: Fingerprints in one block of an index entry; larger entries are dealt out in pairs of blocks.
BLOCK = 1024


def _triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four positions hold one of them.

    Positions fall in three classes of a ring (0-2, 3-5, 6-7).  Four positions have three in a
    class, or two in a class and one in the next, or two in each of two classes, which comes to
    the same; so triples inside a class and pairs with one of the next class do.
    """
    ring = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for c in ring for t in combinations(c, 3)]
    for i, c in enumerate(ring):
        found += [(*pair, other) for pair in combinations(c, 2) for other in ring[(i + 1) % 3]]
    return found


TRIPLES = _triples()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; bit i is set when set in over half of the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(plain, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1].tolist()
        view = memoryview(plain)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(view[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for texts of any length
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp long) for every row; a text without words, null included, has fingerprint zero.

    The tag, a hash of the text, tells apart rows that repeat an id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from batches(
                ((i, g, fingerprint(t, shingle)) for i, g, t in rows_of(batch, "doc_id", "tag", "text")), schema
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag_of(F.col(text_col)), utf8(F.col(text_col)).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, tag long, fp long")


def tag_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag")


def linked(fps: np.ndarray, triple: int, left: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that hold the linked rows of one entry together: at most one less than rows.

    Rows below ``left`` are of the first block, the others of the second; with left = 0 all are
    compared.  A pair counts under the first triple that it shares only.  Rows already known to be
    connected are not linked again.
    """
    n = len(fps)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    low = np.array([sum(1 << p for p in t) for t in TRIPLES[:triple]], np.uint8)
    octets = fps.view(np.uint8).reshape(n, 8)
    for i in range(left if left else n):
        after = left if left else i + 1
        if after >= n:
            break
        same = octets[after:] == octets[i]
        near = np.flatnonzero(same.sum(1) >= 8 - distance)
        if not len(near):
            continue
        near = near[np.bitwise_count(fps[after + near] ^ fps[i]) <= distance]
        if len(near) and len(low):
            masks = np.packbits(same[near], axis=1, bitorder="little")[:, 0]
            near = near[~((masks[:, None] & low) == low).any(1)]
        for j in (after + near).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (fp, rep; each fp once) to (a, b): links of reps whose components are those of all near pairs."""
    if distance != DISTANCE:
        raise ValueError("the triples are made for four bits")
    octet = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))  # noqa: E731  as numpy sees them
    keys = [
        F.lit(t << 24) + F.shiftleft(octet(p), 16) + F.shiftleft(octet(q), 8) + octet(r) for t, (p, q, r) in enumerate(TRIPLES)
    ]
    entries = prints.select("fp", "rep", F.explode(F.array(*keys)).alias("entry"))
    large = settle(entries.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "entries")
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK).cast("int")
    dealt = (
        entries.join(large, "entry", "left")
        .withColumn("_of", blocks)
        .withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_of")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        .groupBy("entry", F.least("_own", "_other").alias("one"), F.greatest("_own", "_other").alias("two"))
        # at most two blocks of about BLOCK fingerprints each
        .agg(F.collect_list(F.struct(F.col("_own").alias("own"), "fp", "rep")).alias("members"))
        .where(F.size("members") > 1)
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in it:
                for entry, one, two, members in rows_of(batch, "entry", "one", "two", "members"):
                    members.sort(key=lambda m: (m["own"], m["fp"] & (2**64 - 1)))
                    fps = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
                    left = sum(m["own"] == one for m in members) if one != two else 0
                    if one != two and left in (0, len(members)):
                        continue
                    for i, j in linked(fps, entry >> 24, left, distance):
                        yield members[i]["rep"], members[j]["rep"]

        yield from batches(found(), schema)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``distance`` bits.  Texts
    without words share fingerprint zero.  Repeated rows come back as often as given.  A row whose
    id is null has nothing to link by: it gets its fingerprint and a null component.
    """
    return _classes(docs, shingle, distance, id_col, text_col).drop("tag")


def _classes(docs: DataFrame, shingle: int, distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    each = settle(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    prints = settle(
        each.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "prints"
    )
    # an id with several texts may stand for several prints: their links run through the id
    found = settle(links(prints.select("fp", "rep"), distance), "near")
    roots = components(found)
    classes = prints.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    out = attach(each, classes, "fp", prints.select("fp", "n"))
    return out.select(
        "doc_id",
        "tag",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def distinct_documents(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for every component: that with the smallest doc_id.

    Of rows that repeat this id, the first by text, then by the other columns, stays.  Rows
    without an id stay, as nothing tells them apart from others.
    """
    stays = settle(
        _classes(docs, shingle, distance).where("doc_id = component_id").groupBy("doc_id", "tag").agg(F.count("*").alias("_n")),
        "stays",
    )
    again = settle(stays.groupBy("doc_id").agg(F.sum("_n").alias("_n")).where("_n > 1").select("doc_id"), "again")
    named = docs.where("doc_id IS NOT NULL")
    kept = named.join(
        stays, (named["doc_id"] == stays["doc_id"]) & (tag_of(named["text"]) == stays["tag"]), "left_semi"
    )
    nameless = docs.where("doc_id IS NULL")
    if again.isEmpty():
        return kept.unionByName(nameless)
    order = Window.partitionBy("doc_id").orderBy(*[quoted(c).asc_nulls_first() for c in ("text", *docs.columns)])
    place = "_place" + "_" * max(map(len, docs.columns))
    first = kept.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return kept.join(again, "doc_id", "left_anti").unionByName(first).unionByName(nameless).select(*[quoted(c) for c in docs.columns])
