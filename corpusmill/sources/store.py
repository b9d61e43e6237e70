"""A versioned vector table on any Hadoop filesystem: parts, and manifests that list them.

An upsert writes one part with its own rows, a delete one part with the ids that go; neither rewrites the table.
A version is a manifest of parts, oldest first, and a later part overrides the ids of the earlier ones. A manifest is written
under a name of its own and published by a rename that replaces nothing, as Spark's streaming log does: no reader sees
half of it, and of two writers of one version number one gets `Conflict` and changes nothing. That is as
exclusive as the filesystem's rename is. A writer builds on the version whose number it read; where the newest manifest does not
parse (an older writer's, cut off) readers pass over it and writers get `Conflict` until vacuum has taken it away.
Once FAN parts follow those that are far larger, they are merged into one, so a row is rewritten a logarithmic number of times
and a read joins few parts. The manifest also holds the length of the vectors, and for every stream the last batch that took effect: a batch
that is replayed after it was published publishes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import vector
from corpusmill.operators import search
from corpusmill.operators.filters import MetadataFilter, compile_filters
from corpusmill.schema import VECTOR_ROW
from corpusmill.session import discard, saved_rows, sized_join

#: Parts that may follow a part before they are merged, and how much larger than all of them a part is that stays out of it.
FAN, LARGER = 8, 4


class Conflict(RuntimeError):
    """Another writer has published the version first; nothing of this call took effect."""


class VectorStore:
    """Rows of VECTOR_ROW (or `schema`) with a fixed vector length."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, schema=VECTOR_ROW) -> None:
        self.spark, self.path, self.dimension, self.schema = spark, path.rstrip("/"), dimension, schema

    # -- versions ---------------------------------------------------------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def _names(self, start: str) -> list[str]:
        _, fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if n.startswith(start))

    def _manifest(self, version: int) -> dict | None:
        """The manifest of a version, or None where it is not complete."""
        jvm, fs, _ = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/m-{version:010d}"))
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        return [int(n[2:]) for n in self._names("m-")]

    def versions(self) -> list[int]:
        return [v for v in self._numbers() if self._manifest(v) is not None]

    def _current(self) -> dict:
        """The newest complete manifest."""
        for v in reversed(self._numbers()):
            found = self._manifest(v)
            if found is not None:
                return found
        raise RuntimeError("the store is not initialized")

    def _newest(self) -> tuple[int, dict]:
        """The newest version and its manifest, for a writer to build on."""
        numbers = self._numbers()
        if not numbers:
            raise RuntimeError("the store is not initialized")
        found = self._manifest(numbers[-1])
        if found is None:
            raise Conflict(f"version {numbers[-1]} is not complete")
        return numbers[-1], found

    def _publish(self, parts: list[dict], after: int, applied: dict[str, int] | None = None) -> None:
        jvm, fs, root = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        draft, name = path(f"{self.path}/t-{uuid.uuid4().hex}"), path(f"{self.path}/m-{after + 1:010d}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"parts": parts, "dimension": self.dimension, "applied": applied or {}}).encode()))
        finally:
            out.close()
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, name, keep)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {after + 1} exists") from e
            raise

    # -- parts ------------------------------------------------------------
    def _write(self, rows: DataFrame, gone: bool = False) -> dict:
        """A new part: rows of the table, or ids that go."""
        name = f"p-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return {"name": name, "gone": gone, "rows": self.spark.read.parquet(f"{self.path}/{name}").count()}  # of footers alone

    def _open(self, part: dict) -> DataFrame:
        schema = self.schema["id"].dataType.simpleString()
        reader = self.spark.read.schema(f"id {schema}" if part["gone"] else self.schema)
        return reader.parquet(f"{self.path}/{part['name']}")

    def _view(self, parts: list[dict]) -> DataFrame:
        """Rows of the parts, each id from the newest part that has it."""
        rows, newer = self.spark.createDataFrame([], self.schema), None
        for part in reversed(parts):
            own = self._open(part)
            if not part["gone"]:
                left = own if newer is None else own.join(newer, "id", "left_anti")
                rows = rows.unionByName(left.select(*self.schema.fieldNames()))
            newer = own.select("id") if newer is None else newer.union(own.select("id"))
        return rows

    def _merged(self, parts: list[dict]) -> list[dict]:
        """The parts, with the last ones merged where more than FAN follow a part that is far larger."""
        at = 0
        while at < len(parts) and parts[at]["rows"] > LARGER * sum(p["rows"] for p in parts[at + 1 :]):
            at += 1
        if len(parts) - at <= FAN:
            return parts
        tail, out = parts[at:], list(parts[:at])
        if at and any(p["gone"] for p in tail):  # what goes has to go from the older parts too
            ids = self._open(tail[0]).select("id")
            for p in tail[1:]:
                ids = ids.union(self._open(p).select("id"))
            gone = ids.distinct().join(self._view(tail).select("id"), "id", "left_anti")
            out.append(self._write(gone, gone=True))
        return [*out, self._write(self._view(tail))]

    def _commit(self, make: Callable[[list[dict]], list[dict]], batch: tuple[str, int] | None = None) -> int:
        """Publish a version with the parts that `make` writes, given those of the newest version; rows of those that hold rows.

        batch: the name of a stream and the number of its batch; one that has taken effect before changes nothing.
        """
        last, manifest = self._newest()
        applied = dict(manifest.get("applied", {}))
        if batch:
            if applied.get(batch[0], -1) >= batch[1]:
                return 0
            applied[batch[0]] = batch[1]
        new = [p for p in make(manifest["parts"]) if p["rows"]]
        self._publish(self._merged([*manifest["parts"], *new]) if new else manifest["parts"], last, applied)
        return sum(p["rows"] for p in new if not p["gone"])

    def applied(self, name: str) -> int:
        """The number of the last batch of a stream that took effect, -1 where there is none."""
        return self._current().get("applied", {}).get(name, -1)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions, and the parts that none of them lists. Not while another writer is at work."""
        jvm, fs, _ = self._fs()
        kept = self.versions()[-keep:]
        used = {p["name"] for v in kept for p in self._manifest(v)["parts"]}
        old = [n for n in self._names("m-") if int(n[2:]) not in kept]
        for n in [*old, *self._names("t-"), *(n for n in self._names("p-") if n not in used)]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)

    # -- contract -----------------------------------------------------------
    def initialize(self) -> None:
        """Create an empty first version where there is none."""
        if not self.versions():
            try:
                self._publish([], max(self._numbers(), default=0))
            except Conflict:  # another writer has just done so
                pass

    def validate(self) -> bool:
        """Whether the newest version can be read and was made for vectors of this length. Rows are checked as they are written, so none is read here."""
        if not self.versions():
            return False
        jvm, fs, _ = self._fs()
        now = self._current()
        there = all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p['name']}")) for p in now["parts"])
        return there and now.get("dimension", self.dimension) == self.dimension

    def read(self, version: int | None = None) -> DataFrame:
        found = self._current() if version is None else self._manifest(version)
        if found is None:
            raise RuntimeError(f"version {version} is not complete")
        return self._view(found["parts"])

    def _write_rows(self, rows: DataFrame, ordinal: str | None, written: bool) -> dict:
        """A new part with the last row of each id, vectors of the right length (others are an error).

        Whole rows move only where their ids may be given twice: those are found by hashes of ids alone. Rows that are not `written` are written
        as they come, which is the part itself if no id is given twice.
        """
        own = [F.col(f.name).cast(f.dataType) for f in self.schema]
        fit = rows.withColumn("embedding", vector.require_dimension(F.col("embedding"), self.dimension))
        fit = fit.select(*own, (F.col(ordinal) if ordinal else F.monotonically_increasing_id()).alias("__ord"))
        part = None if written else self._write(fit)
        if part:
            fit = self.spark.read.schema(fit.schema).parquet(f"{self.path}/{part['name']}")
        twice = fit.select(F.xxhash64("id").alias("__h")).groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1").select("__h")
        twice, n = saved_rows(twice, "ids-twice")
        if n:
            every = sized_join(fit.withColumn("__h", F.xxhash64("id")), twice.withColumn("__twice", F.lit(True)), ["__h"], "left", 16 * n).drop("__h")
            again = last_wins(every.where("__twice"), "id", "__ord")
            out = self._write(every.where("__twice IS NULL").select(*self.schema.fieldNames()).unionByName(again.select(*self.schema.fieldNames())))
            if part:
                jvm, fs, _ = self._fs()
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part['name']}"), True)
            part = out
        discard(twice)
        return part or self._write(fit.select(*self.schema.fieldNames()))

    def upsert(self, rows: DataFrame, ordinal: str | None = None, batch: tuple[str, int] | None = None, written: bool = False) -> int:
        """Replace by id or insert; of rows with one id in the call the last by `ordinal` (or input order) wins. All or nothing. The number of rows written.

        written: the rows come from a written table and are cheap to read more than once.
        """
        return self._commit(lambda _: [self._write_rows(rows, ordinal, written)], batch)

    def replace(self, rows: DataFrame, keys: DataFrame, ordinal: str | None = None, batch: tuple[str, int] | None = None, spread: bool = True, written: bool = False) -> int:
        """Rows take the place of all stored rows of their keys, in one version. The number of rows written. written: as in `upsert`.

        keys: one column of the table (as url); stored rows with one of its values go, those without new rows too, and with `spread` those of the new rows' values.
        """
        (name,) = keys.columns

        def make(parts: list[dict]) -> list[dict]:
            new = self._write_rows(rows, ordinal, written)
            held = self._open(new)
            changed = (keys.union(held.select(name)) if spread else keys).distinct().withColumnRenamed(name, "__key")
            # Only ids and keys of the stored rows are read; a null key is a key.
            old = self._view(parts).select("id", name)
            gone = old.join(changed, F.col(name).eqNullSafe(F.col("__key")), "left_semi").select("id").join(held.select("id"), "id", "left_anti")
            return [self._write(gone, gone=True), new]

        return self._commit(make, batch)

    def delete(self, filters: list[MetadataFilter]) -> None:
        """Remove rows that match all filters; no filter is an error. Rows for which the filters are null stay."""
        if not filters:
            raise ValueError("delete needs a filter")
        self._commit(lambda parts: [self._write(self._view(parts).where(compile_filters(filters, self.schema)).select("id"), gone=True)])

    def count(self) -> int:
        return self.read().count()

    def clear(self) -> None:
        """An empty version; what streams have applied is kept."""
        last, manifest = self._newest()
        self._publish([], last, manifest.get("applied"))

    def capabilities(self) -> dict[str, bool]:
        return {"metadata_filters": True, "upsert": True, "delete": True}

    def similarity_search(self, query: list[float], limit: int = 3, filters: list[MetadataFilter] | None = None, metric: str = "l2") -> DataFrame:
        if len(query) != self.dimension:
            raise ValueError(f"query has {len(query)} components, the store {self.dimension}")
        return search.top_k(self.read(), query, limit, metric, filters)


def last_wins(rows: DataFrame, key: str = "id", ordinal: str | None = None) -> DataFrame:
    """One row a key: that with the greatest ordinal."""
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    numbered = rows.withColumn("__ord", order)
    top = Window.partitionBy(key).orderBy(F.col("__ord").desc())
    return numbered.withColumn("__n", F.row_number().over(top)).where("__n = 1").drop("__ord", "__n")


def merge(base: DataFrame, rows: DataFrame, ordinal: str | None = None, key: str = "id") -> DataFrame:
    """Upsert: base rows whose key is not updated, and the last row of every updated key."""
    new = last_wins(rows, key, ordinal).select(*base.columns)
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new)


def without(base: DataFrame, filters: list[MetadataFilter]) -> DataFrame:
    """Rows that do not match; rows for which the filters are null stay."""
    return base.where(~F.coalesce(compile_filters(filters, base.schema), F.lit(False)))
