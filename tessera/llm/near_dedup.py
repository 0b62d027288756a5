"""MinHash near-dedup by tensored banding.

Two small collections, A and B, hold `m` short minhash bands each. A table key joins one band of A with one of B,
so that m * m tables need the minhashes of 2 * m bands only. A pair of similarity s shares a key
unless all bands of one collection miss: probability 2 * (1 - s**r)**m at most. m is the least for
which that is `miss` or less at the threshold itself; similar pairs miss far less often.

Links are confirmed on full shingle sets, and no bucket is expanded into all its pairs:

1. Within a slice of documents, and again within a key's shard, the members of a bucket are tied to
   its smallest id (a star), so a bucket with a third of all rows reaches a shard as one entry a slice.
2. Star edges whose minhashes agree too seldom for the threshold (a chance of one in a million for a
   link) are refuted by them; the others are verified on the full texts and make components.
   A bucket whose star held lies in one component, and is done.
3. Documents in a component that a refuted edge touches may have a link besides their stars. They get
   longer keys (`FINE_ROWS` minhashes, as many tables as `miss` asks for), which only much more similar texts share.
   Each bucket there that holds several components has a centre, and its members are compared by how they
   differ from it: copies of one text differ from it in few shingles, most of them rare, so that an
   exact prefix filter on the differences finds the links without comparing every copy with every other.

Sets that are equal count as one member of a bucket; their rows are tied together by their digest.

Defined results: null or blank text has the empty set and is linked with nothing; rows that share
an id are one node, linked where any of their rows is; a null id is linked with nothing and is its
own component (null); an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, mix64, scratch, slices, text_of, utf8
from .components import components
from .shingles import shared, shingle_sets

#: minhashes of a band, and of a key in the second round
ROWS, FINE_ROWS = 3, 10
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("set", "<u8")])
#: as sent: the key and the row of a table of (id, set)
SENT = np.dtype([("key", "<u8"), ("row", "<u2")])
MEMBER = np.dtype([("id", "<i8"), ("set", "<u8")])
#: table entries behind one shard
SHARD_ENTRIES = 2_000_000


def bands_for(threshold: float, miss: float, rows: int = ROWS) -> int:
    m = 1
    while 2 * (1 - threshold**rows) ** m > miss:
        m += 1
    return m


def least_agreement(n: int, threshold: float, miss: float = 1e-6) -> int:
    """Fewest of n minhashes in which a pair at the threshold agrees, but for a chance of `miss`."""
    tail, k = 0.0, 0
    while tail <= miss:
        tail += comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        k += 1
    return k - 1


def _minhashes(sets: np.ndarray, places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n x texts; texts have sets that are not empty."""
    first = places[:-1]
    rng = np.random.default_rng(seed)
    out = np.empty((n, len(first)), np.uint64)
    for k in range(n):
        xor, odd = rng.integers(0, 2**64, 2, np.uint64)
        out[k] = np.minimum.reduceat(((sets ^ xor) * (odd | np.uint64(1))) >> np.uint64(16), first)
    return out


def _bands(minhashes: np.ndarray, rows: int) -> np.ndarray:
    """Joins each `rows` minhashes into one 64-bit band."""
    n = len(minhashes) // rows
    out = np.zeros((n, minhashes.shape[1]), np.uint64)
    for j in range(rows):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + minhashes[j : n * rows : rows] + np.uint64(j))
    return mix64(out + np.arange(n, dtype=np.uint64)[:, None])


def _tensor(bands: np.ndarray, m: int) -> np.ndarray:
    """texts x m*m table keys, from texts x 2*m bands."""
    a, b = bands[:, :m], bands[:, m:]
    return mix64(a[:, :, None] + (b * np.uint64(0x9E3779B97F4A7C15))[:, None, :]).reshape(len(bands), m * m)


SIGNATURE = "doc_id long, digest binary, n_shingles long, bands binary, sketch binary"


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, m: int) -> DataFrame:
    """Digest and size of each row's set, its 2 * m bands, and 16 bits of each of their minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                sets, places = shingle_sets(*utf8(batch.column(1)), width)
                size = np.diff(places)
                full = size > 0
                bands, sketch = [b""] * len(size), [b""] * len(size)
                if full.any():
                    mins = _minhashes(sets, np.append(places[:-1][full], len(sets)), 2 * m * ROWS, 20240229)
                    for i, x, y in zip(np.flatnonzero(full).tolist(), np.ascontiguousarray(_bands(mins, ROWS).T), np.ascontiguousarray(mix64(mins).astype(np.uint16).T), strict=True):
                        bands[i], sketch[i] = x.tobytes(), y.tobytes()
                digests = [hashlib.blake2b(sets[s:e].tobytes(), digest_size=16).digest() for s, e in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digests, pa.binary()), pa.array(size), pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())],
                    ["doc_id", "digest", "n_shingles", "bands", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(run, SIGNATURE)


def _stars(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of least id for each key, and the (hub, member) edges of members with other sets."""
    order = np.lexsort((entries["id"], entries["set"], entries["key"]))
    entries = entries[order]
    same_key = entries["key"][1:] == entries["key"][:-1]
    entries = entries[np.r_[True, ~same_key | (entries["set"][1:] != entries["set"][:-1])]]  # equal sets: the least id
    if not len(entries):
        return entries, np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.r_[True, entries["key"][1:] != entries["key"][:-1]])
    bucket = np.cumsum(np.r_[True, entries["key"][1:] != entries["key"][:-1]]) - 1
    hub_id = np.minimum.reduceat(entries["id"], first)
    is_hub = entries["id"] == hub_id[bucket]
    edges = np.stack([hub_id[bucket], entries["id"]], axis=1)[~is_hub]
    hubs = entries[is_hub]
    return hubs, np.unique(edges, axis=0) if len(edges) else edges


def star_edges(signed: DataFrame, m: int, shards: int) -> DataFrame:
    """Distinct (a, b), a < b: star edges of all buckets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                batch = whole.slice(start, 4000)
                n = batch.num_rows
                keys = _tensor(np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(n, 2 * m), m)
                digests = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(n, 2)[:, 0]
                ids = batch.column(0).to_numpy()
                entries = np.empty((n, m * m), ENTRY)
                entries["key"], entries["id"], entries["set"] = keys, ids[:, None], digests[:, None]
                hubs, edges = _stars(entries.reshape(-1))
                shard = (hubs["key"] % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                hubs, shard = hubs[order], shard[order]
                names, first = np.unique(shard, return_index=True)
                tables, parts = [], []
                for part in np.split(hubs, first[1:]):
                    member = np.empty(len(part), MEMBER)
                    member["id"], member["set"] = part["id"], part["set"]
                    table, row = np.unique(member, return_inverse=True)
                    sent = np.empty(len(part), SENT)
                    sent["key"], sent["row"] = part["key"], row
                    tables.append(table.tobytes())
                    parts.append(sent.tobytes())
                known = [b""] * len(parts)
                if parts:  # edges found here ride along with some shard
                    known[start // 4000 % len(parts)] = edges.astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(x, pa.binary()) for x in (tables, parts, known))], ["shard", "members", "entries", "edges"])

    def meet(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        entries = []
        for table, blob in zip(parts["members"], parts["entries"], strict=True):
            sent = np.frombuffer(blob, SENT)
            member = np.frombuffer(table, MEMBER)[sent["row"]]
            entries.append(np.empty(len(sent), ENTRY))
            entries[-1]["key"], entries[-1]["id"], entries[-1]["set"] = sent["key"], member["id"], member["set"]
        _, found = _stars(np.concatenate(entries))
        known = np.frombuffer(b"".join(parts["edges"]), "<i8").reshape(-1, 2)
        return pd.DataFrame(np.unique(np.concatenate([found, known]), axis=0), columns=["a", "b"])

    rows = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest", "bands")
    return rows.mapInArrow(deal, "shard int, members binary, entries binary, edges binary").groupBy("shard").applyInPandas(meet, "a long, b long").distinct()


def plausible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(a, b, may): whether sizes and minhashes leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(n, -1) for i in (2, 3))
            small, large = (f(batch.column(4).to_numpy(), batch.column(5).to_numpy()) for f in (np.minimum, np.maximum))
            may = ((x == y).sum(axis=1) >= least_agreement(x.shape[1], percent / 100)) & (100 * small >= percent * large)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(may)], ["a", "b", "may"])

    of = lambda c: signed.where("n_shingles > 0").select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    return rows.mapInArrow(run, "a long, b long, may boolean").groupBy("a", "b").agg(F.max("may").alias("may"))


def overlaps(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Full sets of both texts of each pair: (a, b, shared, na, nb, rest: how much of b is not in a, linked). texts: id, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, 2 << 20):
                a, at_a = shingle_sets(*utf8(batch.column(2)), width)
                b, at_b = shingle_sets(*utf8(batch.column(3)), width)
                both = [shared(a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(np.diff(at_a)), pa.array(np.diff(at_b))], ["a", "b", "shared", "na", "nb"])

    with_b = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    counted = with_both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, shared long, na long, nb long")
    linked = (F.col("shared") > 0) & (100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared")))
    return counted.groupBy("a", "b").agg(F.max("shared").alias("shared"), F.min("na").alias("na"), F.min("nb").alias("nb"), F.max(F.col("nb") - F.col("shared")).alias("rest"), F.max(linked).alias("linked"))


def fine_keys(texts: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """(key, id): long keys of texts (id, t), in as many tables as the chance of a miss asks for."""
    tables = 1
    while (1 - (percent / 100) ** FINE_ROWS) ** tables > miss:
        tables += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                sets, places = shingle_sets(*utf8(batch.column(1)), width)
                if len(sets):
                    full = np.diff(places) > 0
                    keys = _bands(_minhashes(sets, np.append(places[:-1][full], len(sets)), tables * FINE_ROWS, 20240301), FINE_ROWS)
                    ids = np.tile(batch.column(0).to_numpy()[full], tables)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])

    return texts.mapInArrow(run, "key long, id long")


def centred_groups(members: DataFrame) -> DataFrame:
    """(c, id, root): each member of a bucket with the bucket's centre. members: key, id, root.

    A component's centre is its member with the most company in its buckets; a bucket takes the centre of its largest component.
    Any centre gives the same links; one amid its group leaves the smallest differences.
    """
    company = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    scores = members.join(company, "key").groupBy("id", "root").agg(F.sum("n").alias("score"))
    centres = scores.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("score", (-F.col("id")).alias("c"))).alias("best"))
    of_key = members.select("key", "root").distinct().join(centres, "root").groupBy("key").agg(F.max(F.struct("size", "best")).alias("m"))
    return members.join(of_key.select("key", (-F.col("m.best.c")).alias("c")), "key").select("c", "id", "root").distinct()


def differences(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(c, ct, root, x, n, nc, inner, linked, delta): how the full set of x differs from that of its group's centre.

    ct tells apart the texts of an id that is there several times; inner: shingles shared with the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4, 2 << 20):
                centre = batch.column(3).dictionary_encode()
                c, at_c = shingle_sets(*utf8(centre.dictionary), width)
                ct = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in centre.dictionary.to_pylist()]
                k = centre.indices.to_numpy()
                x, at_x = shingle_sets(*utf8(batch.column(4)), width)
                delta = [np.setxor1d(c[at_c[k[i]] : at_c[k[i] + 1]], x[at_x[i] : at_x[i + 1]], assume_unique=True) for i in range(batch.num_rows)]
                nc, n = np.diff(at_c)[k], np.diff(at_x)
                places = np.cumsum([0, *map(len, delta)])
                inner = (nc + n - np.diff(places)) // 2
                linked = (inner > 0) & (100 * inner >= percent * (nc + n - inner))
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(delta).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), pa.array(np.array(ct, np.int64)[k]), pa.array(n), pa.array(nc), pa.array(inner), pa.array(linked), lists],
                    ["c", "root", "x", "ct", "n", "nc", "inner", "linked", "delta"],
                )

    rows = groups.where("id != c").join(texts.select("id", F.col("t").alias("tx")), "id").withColumnRenamed("id", "x")
    rows = rows.join(texts.select(F.col("id").alias("c"), F.col("t").alias("tc")), "c").select("c", "root", "x", "tc", "tx")
    return rows.mapInArrow(run, "c long, root long, x long, ct long, n long, nc long, inner long, linked boolean, delta array<long>")


def centred_pairs(deltas: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components whose differences from their centre leave room for a link; no link is left out.

    With t(x, y) the least overlap of a link, x and y are linked just if their differences from the centre c share at
    least k = t(x, y) + |c| - |x & c| - |y & c| shingles. Rarest first (one order for all), the two then share one in the first
    |delta| - k + 1 of each. Documents that are both linked with c need no pair, so that one of a pair is not: it probes with
    its beginning, and the other (of two unlinked ones that which differs less) is indexed by its own, each for the
    least k that a partner allows. Each match is held against what the rest of both differences can still share.
    """
    p = percent
    share = p / (100 + p)
    least = lambda a, b: F.ceil((p * (F.col(a) + F.col(b))) / (100 + p))  # noqa: E731  t
    group, own = ["c", "ct"], ["c", "ct", "x", "root", "n", "nc", "inner", "linked"]
    each = deltas.select(*group, "row", F.explode("delta").alias("e"))
    several = each.groupBy(*group, "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")  # the others come first in the order and meet nobody
    known = each.join(several, [*group, "e"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("known"))  # one document's shingles
    ordered = deltas.select(*own, "row", F.size("delta").alias("d")).join(known, "row")
    # bounds of k from below; 1e-6 guards against what floats lose
    unlinked_partner = F.floor(share * (F.col("n") - F.col("nc")) - 1e-6) + F.col("nc") - F.col("inner") + 1
    larger_partner = F.ceil(F.col("nc") - 2 * F.col("inner") + (share + 0.5) * F.col("n") + (share - 0.5) * (100 * F.col("n") / p) - 1e-6)
    any_partner = F.ceil(share * (F.col("n") + F.col("nc")) - 1e-6) - F.col("inner")
    within_partner = F.ceil((2 * share - 1) * (100 * F.col("n") / p) + 2 * share * F.col("n") + F.col("nc") - 2 * F.col("inner") - 1e-6)
    ordered = ordered.withColumns(
        {"k_index": F.greatest(F.lit(1), unlinked_partner, F.when(~F.col("linked"), larger_partner)), "k_probe": F.greatest(F.lit(1), any_partner, within_partner), "lone": F.col("d") - F.size("known")}
    )
    ordered = materialize(ordered, "ordered")

    def beginning(rows: DataFrame, k: str, side: str) -> DataFrame:
        taken = F.greatest(F.lit(0), F.col("d") - F.col(k) + 1 - F.col("lone")).cast("int")
        rows = rows.select(*own, "d", "lone", F.posexplode(F.slice("known", F.lit(1), taken)).alias("pos", "s"))
        return rows.select(*group, F.col("s.e").alias("e"), *[F.col(c).alias(f"{c}_{side}") for c in ("x", "root", "n", "inner", "d", "linked")], "nc", (F.col("d") - F.col("lone") - F.col("pos")).alias(f"rest_{side}"))

    index, probe = beginning(ordered, "k_index", "i"), beginning(ordered.where("not linked"), "k_probe", "p").drop("nc")
    k = least("n_i", "n_p") + F.col("nc") - F.col("inner_i") - F.col("inner_p")
    fits = (F.col("root_i") != F.col("root_p")) & (F.col("linked_i") | (F.col("d_i") <= F.col("d_p"))) & (F.least("rest_i", "rest_p") >= k)
    return index.join(probe, [*group, "e"]).where(fits).select(F.least("x_i", "x_p").alias("a"), F.greatest("x_i", "x_p").alias("b")).distinct()


def cross_links(keys: DataFrame, roots: DataFrame, signed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links between different components that share a bucket. keys: key, id; roots: node, root."""
    members = keys.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")).distinct()
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    members = materialize(members.join(mixed, "key", "left_semi"), "mixed")
    deltas = materialize(differences(centred_groups(members), texts, width, percent).withColumn("row", F.monotonically_increasing_id()), "differences")
    near = deltas.where("linked").select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b"))
    pairs = centred_pairs(deltas, percent)
    further = overlaps(plausible(pairs, signed, percent).where("may"), texts, width, percent).where("linked").select("a", "b")
    return near.union(further).distinct()


def linked_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Written tables: the signatures of all rows, and (node, root) of all that are linked."""
    m = bands_for(percent / 100, miss)
    signed = materialize(signatures(docs, id_col, text_col, width, m), "signatures")
    shards = max(1, -(-signed.count() * m * m // SHARD_ENTRIES))
    stars = materialize(plausible(star_edges(signed, m, shards), signed, percent), "stars")
    equal = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest")
    least = equal.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = equal.join(least, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a != b")
    # whole texts of all that may take part, dealt once
    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct().union(copies.select("b")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    texts = materialize(rows.join(wanted, "id", "left_semi"), "candidate-texts")
    tested = materialize(overlaps(stars.where("may"), texts, width, percent).select("a", "b", "linked"), "tested")
    links = tested.where("linked").select("a", "b").union(copies)
    roots = materialize(components(links), "roots")
    refuted = stars.where("not may").select("a", "b").union(tested.where("not linked").select("a", "b"))
    if not refuted.isEmpty():
        ends = refuted.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
        # one member of equal sets will do
        single = least.select(F.col("rep").alias("id")).join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        open_ = single.join(ends, "root", "left_semi").select("id")
        keys = fine_keys(texts.join(open_, "id", "left_semi"), width, percent, miss)
        more = materialize(cross_links(keys, roots, signed, texts, width, percent), "more")
        if not more.isEmpty():
            tied = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
            roots = materialize(components(tied.union(more)), "roots")
    return signed, roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id linked with it), kept."""
    with scratch() as kept:
        signed, roots = map(kept, linked_rows(docs, id_col, text_col, width, percent, miss))
    out = signed.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns: one document (the least id) of each component."""
    (own,) = fresh(docs.columns, "kept_id")
    kept = near_duplicates(docs, id_col, text_col, width, percent).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[own]), "left_semi")
