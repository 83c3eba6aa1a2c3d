"""A key-value table of hash buckets in a shared folder: lookups read, and writes rewrite, the buckets that they touch.

Buckets are folders of Parquet files; a manifest names the folder of each. A write makes new folders for touched buckets and
then the next manifest, which the file system creates only if it isn't there: of two writers that started from the same manifest the
later one merges again, onto the other's rows. Readers see one manifest, whole. Folders that neither of the last ``KEEP`` manifests
names are removed after a write, as are their manifests, so that the table takes the space of its rows a few times over, however many writes
there were. Rows of a write that failed before its manifest are never seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Manifests (and what they name) that stay for readers which began before a write.
KEEP = 3


class BucketStore:
    """Rows by key; of rows with an equal key the last written stays, or the one greatest in ``order``."""

    def __init__(self, spark: SparkSession, root: str, key: str | list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), [key] if isinstance(key, str) else list(key), buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.scala.io.Source.fromInputStream(stream, "UTF-8").mkString()

    def _numbers(self) -> list[int]:
        if not self._files.exists(self._path("manifests")):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path("manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> tuple[int, dict[int, str], str | None]:
        """Number, folder of each bucket, and schema (None before the first write)."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}, None
        return numbers[-1], *self._load(numbers[-1])

    def _load(self, number: int) -> tuple[dict[int, str], str]:
        stream = self._files.open(self._path(f"manifests/{number}"))
        try:
            held = json.loads(self._text(stream))
        finally:
            stream.close()
        return {int(b): p for b, p in held["buckets"].items()}, held["schema"]

    def _create(self, number: int, folders: dict[int, str], schema: str) -> bool:
        """Writes a manifest under its number; False if another writer was first.

        The bytes are there before the name is: a rename doesn't replace a file that exists.
        """
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"manifests/{number}")
        self._files.mkdirs(self._path("manifests"))
        stream = self._files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"buckets": folders, "schema": schema}).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            options.rename(self._qualified(draft), self._qualified(final), self._no_overwrite())
            return True
        except Exception as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def _qualified(self, path):
        return self._files.makeQualified(path)

    def _no_overwrite(self):
        sc = self.spark.sparkContext
        none = getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        options = sc._gateway.new_array(getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = none
        return options

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # ``buckets`` rows at most

    def _of(self, folders: dict[int, str], schema: str | None, only: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.root}/{p}" for b, p in sorted(folders.items()) if only is None or b in only]
        if schema is None:
            return None
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows."""
        _, folders, schema = self.manifest()
        if schema is None:
            raise FileNotFoundError(f"nothing was written to {self.root} yet")
        return self._of(folders, schema).drop("__write")

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys, each once, from their buckets only; keys without a row give none."""
        _, folders, schema = self.manifest()
        keys = keys.select(*self.key).distinct()
        if schema is None:
            raise FileNotFoundError(f"nothing was written to {self.root} yet")
        return self._of(folders, schema, self._touched(keys)).drop("__write").join(keys, self.key, "left_semi")

    def set(self, rows: DataFrame, order: str | None = None, tries: int = 10) -> int:
        """Merges rows in and gives the manifest's number; null keys are left out.

        Without ``order`` a row replaces what was written before; of equal keys in ``rows`` one stays, the greatest by all its columns.
        """
        rows = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key))
        touched = self._touched(rows)
        if not touched:
            return self.manifest()[0]
        for _ in range(tries):
            number, folders, schema = self.manifest()
            new = rows.withColumn("__write", F.lit(number + 1).cast("long"))
            old = self._of(folders, schema, touched)
            both = new if old is None else old.unionByName(new, allowMissingColumns=True)
            others = [c for c in both.columns if c not in self.key]
            rank = F.struct(*([order] if order else []), "__write", *[c for c in others if c not in (order, "__write")])
            best = both.groupBy(*self.key).agg(F.max_by(F.struct(*others), rank).alias("r")).select(*self.key, "r.*").select(*both.columns)
            fresh = f"data/{number + 1}-{uuid.uuid4().hex}"
            best.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{fresh}")
            now = folders | {b: f"{fresh}/bucket={b}" for b in touched}
            if self._create(number + 1, now, _ddl(both)):
                self._clean()
                return number + 1
            self._files.delete(self._path(fresh), True)
        raise RuntimeError(f"{tries} other writers were faster")

    def _clean(self) -> None:
        """Removes what the last manifests don't name; folders of writes that are under way carry higher numbers."""
        numbers = self._numbers()
        named = {p for n in numbers[-KEEP:] for p in self._load(n)[0].values()}
        for n in numbers[:-KEEP]:
            self._files.delete(self._path(f"manifests/{n}"), False)
        for write in self._files.listStatus(self._path("data")):
            name = write.getPath().getName()
            if int(name.partition("-")[0]) > numbers[-1]:
                continue
            for folder in self._files.listStatus(write.getPath()):
                if (part := folder.getPath().getName()).startswith("bucket=") and f"data/{name}/{part}" not in named:
                    self._files.delete(folder.getPath(), True)
            if not any(p.startswith(f"data/{name}/") for p in named):
                self._files.delete(write.getPath(), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
