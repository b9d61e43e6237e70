"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles (64-bit hashes). Sets are put in size bands. In a
band with largest size h, linked sets (Jaccard >= t) differ in at most D = (1 - t) / (1 + t) * 2h
shingles. The sketch has P = D + 1 + e places; a shingle's hash picks a place and is XORed into its
64-bit word, so equal shingles cancel, and the places in which two sketches differ are at most as many as the
symmetric difference. By the pigeonhole, linked sets agree in 1 + e places: (band, place, word) is the join key.
Whole hashes are XORed, so words of places with a shingle do not agree by chance. Empty places would; a set with at
most e of them leaves them out (one agreeing place stays), any other set is sketched again under another seed, too,
and only a set with more under all SEEDS keeps its empty places as keys. A set close to the next band's
sizes is sketched for that band too, so pairs across a border meet there.

Rows with equal keys are paired inside Arrow batches, where a pair leaves only when the Hamming distance of the
folded bit sketches (one bit flipped a shingle; again at most the symmetric difference) permits a link, first with a
sketch of one width, then with one as wide as the set is large; candidates are verified on the shingle sets, with integers: 100 * common >= percent * union. First every member of a key meets the
first members it can link with, and verified links join components; then one member of each component that a
key holds does the same. Last, all pairs of a key that still lie in different components are met, block by block, so no
link between components is lost while a large group of near copies costs its members, not their pairs.

Equal sets are one class (numbered by a row of it) before anything is paired, so copies never meet each other in a group,
and ids may be null or repeat. Defined results: a text with fewer words than a shingle is one shingle; a text
without words (or null) has an empty set, links with nothing and is its own component; a component's id is the
least one in it, null if all are; rows of an empty set with a null id have a null component; an empty table gives an empty
table; other columns are not read. A text longer than a step of about 2 MB is a step of its own and takes some 23 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.bpe import slices
from corpusmill.llm.components import components
from corpusmill.llm.hot_keys import counted, dealt_join
from corpusmill.llm.textbatch import Words, buffers, mix, shingles, tidy
from corpusmill.session import discard, sized_join, written

#: Sizes of neighbouring bands differ by this factor.
BAND_RATIO = 1.4
#: Members of one key that are paired at once; a larger group is paired block by block.
BLOCK = 256
#: Hash seeds under which a set with many empty places is sketched.
SEEDS = 4
#: One class in SAMPLE tells which keys have so many members that they are dealt to blocks before they are gathered.
SAMPLE = 64
#: Words of the folded sketch that a candidate carries.
FOLD = 16


def band_tops(most: int = 1 << 31) -> np.ndarray:
    """Largest size of each band: 1, 2, 3, ... then growing by BAND_RATIO."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_RATIO)))
    return np.asarray(tops, np.int64)


def max_difference(a, b, percent: int):
    """Largest symmetric difference of linked sets with sizes a and b: common >= percent (a + b) / (100 + percent)."""
    common = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * common


def band_difference(top, percent: int):
    """Largest symmetric difference of any linked sets no larger than `top`. max_difference itself is not monotone in the sizes."""
    return 2 * top * (100 - percent) // (100 + percent)


def places(top, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per band (by its largest size): places of a sketch, and how many of them may be empty and left out."""
    top = np.asarray(top, np.int64)
    least = band_difference(top, percent) + 1
    # The smallest sets sketched for a band are those that reach into it from the one below.
    smallest = np.maximum(percent * np.append(0, top[:-1]) // 100, 1)
    spare = np.zeros(len(top), np.int64)
    for _ in range(3):  # more places leave more of them empty
        mean = (least + spare) * np.exp(-smallest / (least + spare))
        spare = np.where(least > 1, np.ceil(mean + 1.5 * np.sqrt(mean)).astype(np.int64), 0)
    return least + spare, spare


#: Makes (row, key) from the shingle hashes, the row of each, and the rows' set sizes.
KeyMaker = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_SIGNED = "id long, k1 long, n int, fp1 long, fp2 long, keys array<bigint>, sketch binary"


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("k1"), text.alias("text"))


def signed(src: DataFrame, size: int, make: KeyMaker) -> DataFrame:
    """One pass over the texts: set size, a 128-bit fingerprint of the set, its join keys and its folded bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, off, doc = distinct_sets(part.column("text"), size)
                n = np.diff(off)
                fp1 = _sums(h, off) + mix(n.astype(np.uint64))
                fp2 = _sums(mix(h), off)
                owner, key = make(h, doc, n)
                order = np.argsort(owner, kind="stable")
                key_off = np.searchsorted(owner[order], np.arange(len(n) + 1)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(key_off), pa.array(key[order].view(np.int64)))
                fold = bit_sketch(h, doc, len(n))
                data = pa.array([x.tobytes() for x in fold], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k1"), pa.array(n.astype(np.int32)), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), keys, data], names=["id", "k1", "n", "fp1", "fp2", "keys", "sketch"])

    return src.mapInArrow(tidy(run), _SIGNED)


def parity_keys(percent: int) -> KeyMaker:
    """Keys of the parity sketches of a set's own band and, where it can link into it, of the next band."""

    def make(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tops = band_tops()
        count, spare = places(tops, percent)
        band = np.searchsorted(tops, n)
        # The next band as well, if its smallest set can link with this one.
        reach = (n > 0) & (100 * n >= percent * (tops[band] + 1))
        made = [_band_keys(h, doc, band + add, who, count, spare) for add, who in ((0, n > 0), (1, reach))]
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])

    return make


def _band_keys(h: np.ndarray, doc: np.ndarray, band: np.ndarray, who: np.ndarray, count: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the places of the sketches that the rows in `who` have for `band`."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for seed in range(SEEDS):
        some = np.flatnonzero(who)
        if not len(some):
            break
        pick = who[doc]
        own = (np.cumsum(who) - 1)[doc[pick]]
        parts = count[band[some]]
        start = np.concatenate([[0], np.cumsum(parts)])
        mine = mix(h[pick] + np.uint64(seed))
        at = start[own] + (((mine >> np.uint64(32)) * parts.astype(np.uint64)[own]) >> np.uint64(32)).astype(np.int64)
        words = np.zeros(start[-1], np.uint64)
        np.bitwise_xor.at(words, at, mine)
        full = np.bincount(at, minlength=start[-1]) > 0
        owner = np.repeat(np.arange(len(some)), parts)
        many = np.bincount(owner[~full], minlength=len(some)) > spare[band[some]]
        emit = full | (many[owner] if seed == SEEDS - 1 else False)
        place = (np.arange(start[-1]) - start[owner])[emit]
        owner, words = owner[emit], words[emit]
        where = (band[some][owner].astype(np.uint64) << np.uint64(40)) + (place.astype(np.uint64) << np.uint64(3)) + np.uint64(seed)
        rows.append(some[owner])
        keys.append(mix(mix(words ^ mix(where)) + np.uint64(1)))
        who = np.zeros(len(who), bool)
        who[some[many]] = True
    return np.concatenate(rows), np.concatenate(keys)


def hashed_sets(src: DataFrame, size: int) -> DataFrame:
    """id, n, the sorted distinct shingle hashes and a bit sketch as wide as the set is large of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, off, _ = distinct_sets(part.column("text"), size)
                hashes = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
                wide = pa.array([wide_sketch(h[x:y]).tobytes() for x, y in zip(off, off[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(off).astype(np.int32)), hashes, wide], names=["id", "n", "hashes", "wide"])

    return src.select("id", "text").mapInArrow(tidy(run), "id long, n int, hashes array<bigint>, wide binary")


def wide_sketch(h: np.ndarray) -> np.ndarray:
    """Every shingle of one set flips one of two to four times as many bits; the words are a power of two."""
    words = 1 << max(0, (2 * len(h) - 1) // 64).bit_length()
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((mix(h) >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two wide sketches, the wider one folded: at most the symmetric difference of the sets."""
    while len(x) > len(y):
        x = x[::2] ^ x[1::2]
    while len(y) > len(x):
        y = y[::2] ^ y[1::2]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def close_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and wide sketches permit to link: hashes, many times as large, are sent for these only."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = max_difference(batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64), percent)
            words = (np.frombuffer(memoryview(v.as_buffer()), np.uint64) for pair in zip(batch.column("x"), batch.column("y"), strict=True) for v in pair)
            near = pa.array([distance(x, y) <= m for x, y, m in zip(words, words, most.tolist(), strict=False)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(near)

    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(run), "a long, b long")


def distinct_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, offsets, and the text of each hash."""
    raw, off = buffers(texts)
    h, first = shingles(Words(raw, off), size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off))), doc


def _sums(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def bit_sketch(h: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Rows of FOLD words; every shingle flips one of their bits."""
    out = np.zeros((rows, FOLD), np.uint64)
    place = (mix(h) >> np.uint64(32)) * np.uint64(FOLD) >> np.uint64(32)
    np.bitwise_xor.at(out.reshape(-1), doc * FOLD + place.astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows can link: by their sizes and the Hamming distance of the folded sketches."""
    ok = np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b])
    ok[ok] = np.bitwise_count(sketch[a[ok]] ^ sketch[b[ok]]).sum(axis=1, dtype=np.int64) <= max_difference(n[a[ok]], n[b[ok]], percent)
    return ok


def first_partners(unit: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row the first row of its unit that it can link with. Rows are sorted by unit."""
    head = np.searchsorted(unit, unit)
    out_a, out_b = [], []
    place, open_rows = 0, np.arange(len(unit))
    while len(open_rows):
        open_rows = open_rows[head[open_rows] + place < open_rows]
        a = head[open_rows] + place
        ok = _near(a, open_rows, n, sketch, percent)
        out_a.append(a[ok])
        out_b.append(open_rows[ok])
        open_rows, place = open_rows[~ok], place + 1
    return np.concatenate(out_a) if out_a else np.zeros(0, np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64)


def open_pairs(unit: np.ndarray, block: np.ndarray, own: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of a unit that can link and are in different components; own: the unit is one block with itself."""
    out_a, out_b = [], []
    d, live = 1, np.arange(max(len(unit) - 1, 0))
    while len(live):
        live = live[live + d < len(unit)]
        live = live[unit[live] == unit[live + d]]
        a, b = live, live + d
        ok = (comp[a] != comp[b]) & (own[a] | (block[a] != block[b]))
        a, b = a[ok], b[ok]
        near = _near(a, b, n, sketch, percent)
        out_a.append(a[near])
        out_b.append(b[near])
        d += 1
    return np.concatenate(out_a) if out_a else np.zeros(0, np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64)


def shared_keys(key_rows: DataFrame) -> DataFrame:
    """key, id and block of the members of every key with two members or more; of keys with the same members, one.

    Keys that look large in a sample of the ids are dealt to blocks beforehand, so that no task gathers a large group;
    the sample decides about the dealing only, and what a key's members are does not depend on it.
    """
    large = written(key_rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("key").count().where(F.col("count") >= SAMPLE).select("key", F.ceil(F.col("count") * SAMPLE / BLOCK).cast("int").alias("blocks")), "large-keys")
    n = large.count()
    if n:
        dealt = sized_join(key_rows, large, ["key"], "left", 16 * n)
        # Another dealing for each key, so that blocks of one key tie those of others together.
        dealt = dealt.withColumn("deal", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("id", "key"), F.col("blocks"))).cast("int"))
        split = dealt.where("deal IS NOT NULL").select("key", "id", F.col("deal").alias("block"))
        key_rows = dealt.where("deal IS NULL").select("key", "id")
    whole = Window.partitionBy("key")
    w = whole.orderBy("id")
    ranked = key_rows.select("key", "id", F.row_number().over(w).alias("rn"), F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))
    ranked = ranked.where(F.col("before").isNotNull() | F.col("after").isNotNull())
    # Close sets agree in many places, so many keys have the same members (by count and 128 bits): one of them says it all.
    print_of = lambda seed: F.when(F.col("rn") == 1, F.bit_xor(F.xxhash64(F.lit(seed), "id")).over(whole))
    ranked = ranked.select("key", "id", ((F.col("rn") - 1) / BLOCK).cast("int").alias("block"), print_of(1).alias("p1"), print_of(2).alias("p2"), F.when(F.col("rn") == 1, F.count("*").over(whole)).alias("members"))
    every = written(ranked, "repeated-keys")
    one = every.where("members IS NOT NULL").groupBy("members", "p1", "p2").agg(F.min("key").alias("key")).select("key")
    out = every.select("key", "id", "block").join(one, "key", "left_semi")
    out = written(out.union(split) if n else out, "shared-keys")
    discard(large, every)
    return out


def _paired(rows: DataFrame, percent: int, pairing: str) -> DataFrame:
    """Distinct (a, b), a < b, of the rows (unit, block, own, comp, id, n, sketch)."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    clustered = rows.repartition(parts, "unit").sortWithinPartitions("unit", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table) -> pa.RecordBatch:
            ids, unit, n = (np.asarray(t.column(c)) for c in ("id", "unit", "n"))
            n = n.astype(np.int64)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(ids), FOLD)
            if pairing == "first":
                a, b = first_partners(unit, n, sketch, percent)
            else:
                a, b = open_pairs(unit, np.asarray(t.column("block")), np.asarray(t.column("own").to_numpy()), np.asarray(t.column("comp")), n, sketch, percent)
            pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            unit = np.asarray(t.column("unit"))
            if not len(unit):
                continue
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut:
                yield flush(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield flush(held)

    return clustered.mapInArrow(tidy(run), "a long, b long").where("a < b").distinct()


def _with_sketches(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    return rows.join(sketches, "id")


def first_candidates(shared: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Within every block of a key, each member b with the first members a it can link, two at most: they are enough to connect
    most of a group, and the rounds after meet whatever stays apart."""
    rows = _with_sketches(shared, sketches).select(F.xxhash64("key", "block").alias("unit"), "block", F.lit(True).alias("own"), F.lit(0).cast("long").alias("comp"), "id", "n", "sketch")
    ends = _paired(rows, percent, "first").groupBy("b").agg(F.array_distinct(F.array(F.min("a"), F.max("a"))).alias("a"))
    return ends.select(F.explode("a").alias("a"), "b")


def _open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """key, id, block, comp and blocks of the keys whose members the links leave in different components, written."""
    comp = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labelled = shared.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "block", F.coalesce("component", "id").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), (F.max("block") + 1).alias("blocks")).where("x < y").select("key", "blocks")
    out = written(labelled.join(mixed, "key"), "open-keys")
    discard(comp)
    return out


def component_candidates(opened: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """One member of each component that an open key holds, with the first such members it can link."""
    heads = opened.groupBy("key", "comp").agg(F.min("id").alias("id")).select("key", "id")
    w = Window.partitionBy("key").orderBy("id")
    return first_candidates(heads.select("key", "id", ((F.row_number().over(w) - 1) / BLOCK).cast("int").alias("block")), sketches, percent)


def open_candidates(opened: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of a key, in any blocks, that can link and that no verified link connects yet."""
    dealt = _with_sketches(opened, sketches).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return _paired(dealt.select(unit.alias("unit"), "block", (F.col("block") == F.col("other")).alias("own"), "comp", "id", "n", "sketch"), percent, "open")


def verify(pairs: DataFrame, src: DataFrame, where: DataFrame, percent: int, size: int, label: str, again: bool) -> DataFrame:
    """Pairs (a < b) of classes whose sets have 100 * common >= percent * union, written.

    Only texts of candidates are hashed again; `where` names a row of each class by its id and text hash, and `again` tells
    whether any row comes twice.
    """
    pairs = written(pairs, f"{label}-pairs")
    members = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    asked = written(where.join(members, "class", "left_semi").select("class", F.col("rid").alias("id"), "k1"), f"{label}-candidates")
    known = src.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    texts = sized_join(known, asked, ["id", "k1"], "inner", 32 * asked.count())
    sets = hashed_sets(texts.select(F.col("class").alias("id"), "text"), size)
    hashed = written(sets.dropDuplicates(["id"]) if again else sets, f"{label}-sets")
    close = written(close_pairs(pairs, hashed, percent), f"{label}-close")
    left = hashed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = hashed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    # Joined one side after the other; each is an equi-join that AQE can split at a hub.
    both = close.join(left, "a").join(right, "b").select("a", "b", "na", "nb", common.alias("common"))
    out = written(both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "common"), f"{label}-links")
    discard(pairs, asked, hashed, close)
    return out


#: Stands for a null id where rows are looked up.
_NO_ID = -(2**63)


def link(src: DataFrame, percent: int, size: int, make: KeyMaker) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links) of the rows (id, k1, text).

    rows: id, n, fp1, fp2 of every row. classes: n, fp1, fp2, class (a number), least (the smallest id) and times (rows) of every distinct
    set that is not empty. links: verified pairs a < b of classes, and their common size, that connect the same components as all linked pairs do.
    """
    # The number of a row is fixed by being written.
    base = written(signed(src, size, make).withColumn("row", F.monotonically_increasing_id()), "sets")
    one = F.min(F.struct("row", F.coalesce("id", F.lit(_NO_ID)).alias("rid"), "k1"))
    classes = base.where("n > 0").groupBy("n", "fp1", "fp2").agg(one.alias("one"), F.min("id").alias("least"), F.count("*").alias("times"))
    classes = written(classes.select("n", "fp1", "fp2", F.col("one.row").alias("class"), "least", "times", F.col("one.rid").alias("rid"), F.col("one.k1").alias("k1")), "classes")
    reps = sized_join(base.select(F.col("row").alias("id"), "n", "keys", "sketch"), classes.select(F.col("class").alias("id")), ["id"], "left_semi", 16 * classes.count())
    sketches = written(reps.select("id", "n", "sketch"), "sketches")
    shared = shared_keys(reps.select(F.explode("keys").alias("key"), "id"))
    again = base.groupBy("id", "k1").count().where("count > 1").limit(1).count() > 0
    rows = written(base.select("id", "n", "fp1", "fp2"), "members")
    discard(base)
    links = verify(first_candidates(shared, sketches, percent), src, classes, percent, size, "first", again)
    opened = _open(shared, links)
    if opened.limit(1).count():
        found = verify(component_candidates(opened, sketches, percent), src, classes, percent, size, "heads", again)
        if found.limit(1).count():
            links = found.union(links)
            discard(opened)
            opened = _open(shared, links)
        links = verify(open_candidates(opened, sketches, percent), src, classes, percent, size, "open", again).union(links)
    discard(opened)
    discard(sketches, shared)
    return rows, classes, links


def grouped(src: DataFrame, percent: int, size: int, make: KeyMaker) -> DataFrame:
    """id, n and component_id (the smallest id that links reach) of the rows (id, k1, text)."""
    rows, classes, links = link(src, percent, size, make)
    comp = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rooted = written(classes.join(comp.withColumnRenamed("node", "class"), "class", "left").select("n", "fp1", "fp2", "least", "times", F.coalesce("component", "class").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least, "root").select("n", "fp1", "fp2", "component_id"), "components")
    # Classes of very many rows are known by their counts.
    large = counted(rooted, ["n", "fp1", "fp2"], "times")
    discard(comp, rooted, classes)
    with_set = dealt_join(rows.where("n > 0").withColumn("deal_by", F.monotonically_increasing_id()), named, ["n", "fp1", "fp2"], "left", large, F.col("deal_by"))
    # Rows of the empty set, however many, are not joined at all.
    return with_set.select("id", "n", "component_id").union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))


def linked_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) for every row."""
    out = grouped(_source(df, id_col, text_col), percent, size, parity_keys(percent))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
