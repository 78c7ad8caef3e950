"""Collections at rest: Parquet folders of points, cut by a hash bucket of the id, and a commit that names them.

Declared payload fields are columns, so filters on them reach the scan; everything else of the payload is one JSON object in
``extra``.  An upsert writes its rows, and beside them what it leaves of the buckets its ids fall into, to a folder of its own, and only
then commits: until that moment, and if it fails before, readers see the table as it was.  Stored rows are not shuffled for it: a bit
for each says whether it is replaced, and the files are copied without these.  Writing the same batch again gives the same
table, so a failed job is simply run again.  Folders no commit needs any more go by ``expire``.

A collection whose sparse vectors are weighted by IDF keeps its term counts: each upsert adds what its vectors bring and takes
off what those they replace had.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import metric_name
from vecloom.operators.filters import apply_filter
from vecloom.operators.mutate import fold_patches, merge_json, sparse_from_payload
from vecloom.operators.search import check_limit
from vecloom.operators.validate import dense_of as named_dense
from vecloom.operators.validate import split, vector_rules
from vecloom.session import discard, input_bytes, packed, shuffles_dropped, written
from vecloom.sources.aliases import set_alias
from vecloom.sources.commits import CommitLog
from vecloom.spec import CollectionSpec

BUCKET = "bucket"
PIECE = "_piece"
EXTRA = "extra"
# Where a row stands: its file, and its number in there; a batch that is written down numbers all its rows.
FILE, ROW = "_file", "_row"
CHUNK, BITS = "_chunk", "_bits"
# The columns of a batch that hold vectors without a name: every target puts them under its own.
DENSE, SPARSE = "dense", "sparse"
SPARSE_TYPE = "struct<indices: array<int>, values: array<double>>"
# Up to this many ids are looked up as literals, which reach the Bloom filters and statistics of the files.
LITERAL_IDS = 1000
# A task writes what comes from about so many bytes of files, so that its memory does not follow the table's size.
PIECE_BYTES = 8 << 20
# A batch is written down in so many parts by its ids.  One with parts of about so many bytes is shuffled part by part: only one part's shuffle
# files are there at once, and a part goes when the last target has it.
PART, PARTS, PART_BYTES = "_part", 4, 32 << 20
# Buckets of more than so many times the files they need are written in as few as they need again.
CROWDED = 4
# Rows, and the table that they are read from.
Part = tuple[DataFrame, DataFrame | None]
# The bits of 2 ** 15 rows are one value, as Spark's bitmaps hold.
CHUNK_POWER = 15
# So many folders of term counts are folded into one.
TERM_FOLDERS = 16


def bucket_of(spec: CollectionSpec, key: str = "id"):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(spec.buckets)).cast("int")


def schema_of(spec: CollectionSpec) -> T.StructType:
    """Id, vectors, the declared payload fields as columns, and all other payload as one JSON object."""
    fields = ["id string", f"`{spec.dense_column}` array<float>"]
    if spec.sparse_column:
        fields.append(f"`{spec.sparse_column}` {SPARSE_TYPE}")
    fields += [f"`{name}` {dtype}" for name, dtype in spec.payload_types]
    return T._parse_datatype_string(", ".join([*fields, f"{EXTRA} string", f"{BUCKET} int"]))


class PointTable:
    def __init__(self, spark: SparkSession, root: str, spec: CollectionSpec):
        self.spark = spark
        self.spec = spec
        self.root = root.rstrip("/")
        self.path = f"{self.root}/{spec.name}"
        self.commits = CommitLog(spark, f"{self.path}/_commits")

    def exists(self) -> bool:
        return self.commits.newest() is not None

    def ensure(self) -> bool:
        """Create the table with its declared shape if it is missing; True if it was created."""
        metric_name(self.spec.distance)
        self.spec.idf
        if self.exists():
            return False
        shape = {
            "vector_name": self.spec.vector_name, "vector_size": self.spec.vector_size, "distance": self.spec.distance,
            "sparse_vector_name": self.spec.sparse_vector_name, "sparse_modifier": self.spec.sparse_modifier, "buckets": self.spec.buckets,
        }
        self.commits.put({"shape": shape, "buckets": {}, "terms": []}, None)
        return True

    def shape(self) -> dict:
        """The shape the table was created with."""
        return self._commit()[1]["shape"]

    def _commit(self) -> tuple[int, dict]:
        found = self.commits.newest()
        if found is None:
            raise FileNotFoundError(f"table {self.spec.name} does not exist")
        return found

    # --- reading ----------------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        return self._read(self._commit()[1]).drop(BUCKET)

    def _read(self, commit: dict, buckets: Iterable[int] | None = None, located: bool = False) -> DataFrame:
        """The points of a commit, or of some of its buckets: other buckets' folders are not even listed."""
        held = commit["buckets"]
        wanted = held if buckets is None else [str(bucket) for bucket in buckets if str(bucket) in held]
        paths = [f"{self.path}/data/v={held[bucket]}/{BUCKET}={bucket}" for bucket in wanted]
        # The declared schema is given, not inferred: no file is opened to plan a query.
        schema = schema_of(self.spec)
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        where = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)] if located else []
        return found.select(*schema.names, *where)

    def retrieve(self, ids: DataFrame, *, with_payload: bool = True, with_vectors: bool = False) -> DataFrame:
        """Points with the given ids; unknown ids are silently absent.

        Ids tell their buckets, and only those are read.  A few ids go along as literals, so that files and row groups that
        cannot hold them are skipped by their Bloom filters and id ranges; more ids are joined.
        """
        wanted = written(ids.select(F.col("id").cast("string").alias("id")).distinct().withColumn(BUCKET, bucket_of(self.spec)), "wanted")
        few = wanted.limit(LITERAL_IDS + 1).collect()
        commit = self._commit()[1]
        if len(few) <= LITERAL_IDS:
            rows = self._read(commit, sorted({row[BUCKET] for row in few if row["id"] is not None}))
            found = rows.filter(F.col("id").isin([row["id"] for row in few if row["id"] is not None]))
        else:
            buckets = [row[BUCKET] for row in wanted.select(BUCKET).distinct().collect()]
            found = self._read(commit, buckets).join(wanted.select("id"), "id", "left_semi")
        vectors = [self.spec.dense_column, *([self.spec.sparse_column] if self.spec.sparse_column else [])]
        return project(found.drop(BUCKET), vectors, with_payload, with_vectors)

    # --- writing ----------------------------------------------------------------------------------------

    def upsert(self, batch: DataFrame, ordinal: str | None = None, *, vectors: Sequence[str] | None = None) -> int:
        """Put the rows of the batch in place of those with the same id; returns the number of distinct ids.

        Of rows with one id the one with the highest ``ordinal`` counts, without one the last in the batch's own order.  The batch
        is written down first: it is read more than once, and may come from a model.
        """
        rows, parts, tables = _latest(batch, ordinal)
        # Terms are made behind the shuffle, which so carries texts only.
        n = self._merge(rows, vectors, parts, used_up=True, terms=True)
        discard(*tables)
        return n

    def load(self, points: DataFrame) -> None:
        """First load of an empty table, straight from the source; ids must be unique."""
        number, commit = self._commit()
        if commit["buckets"]:
            raise ValueError(f"table {self.spec.name} is not empty")
        folder = self._folder(number)
        placed = self._placed(points, self._files(input_bytes(points), self.spec.buckets))
        self._save(self._numbered(_with_terms(placed, [self]), None), folder)
        done = self._saved(folder)
        buckets = {str(row[BUCKET]): folder for row in done.select(BUCKET).distinct().collect()}
        terms = self._save_terms(self._terms(done, 1), commit, folder)
        self.commits.put({**commit, "buckets": buckets, "terms": terms}, number)

    def _merge(
        self, batch: DataFrame, vectors: Sequence[str] | None, parts: Sequence[Part] = (), *, used_up: bool = False, terms: bool = False
    ) -> int:
        """Put rows in place of those with the same id.  A batch in parts has one row for an id, of others one is taken; a large batch is taken part by
        part, and if it is used up, deleted so."""
        number, commit = self._commit()
        folder = self._folder(number)
        size = input_bytes(batch)
        files = self._files(size, self.spec.buckets)
        unique = bool(parts)
        if parts and size >= PARTS * PART_BYTES:
            # A multiple, so that no file has rows of two parts.
            files = -(-files // PARTS) * PARTS
        else:
            parts = [(batch, None)]
        for rows, table in parts:
            placed = self._placed(rows, files, unique)
            self._save(self._numbered(_with_terms(placed, [self]) if terms else placed, vectors), folder)
            if used_up and table is not None:
                discard(table)
        done = self._saved(folder)
        # At most ``spec.buckets`` numbers.
        touched = done.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()
        if touched:
            old = self._read(commit, [row[BUCKET] for row in touched], located=True)
            held = old.inputFiles()
            delta = self._terms(done, 1)
            if held:
                # Ids only are shuffled.
                each = old.select("id", FILE, ROW).unionByName(done.select("id"), allowMissingColumns=True)
                by = W.partitionBy("id")
                ranked = each.withColumns({
                    "_n": F.row_number().over(by.orderBy(F.col(ROW).asc_nulls_first(), FILE)), "_met": F.bool_or(F.col(ROW).isNull()).over(by)
                }).filter(F.col(ROW).isNotNull())
                with shuffles_dropped(self.spark):
                    gone = written(_bits(ranked.filter("_n > 1"), FILE, ROW), "gone")
                    if self.spec.idf:
                        replaced = written(_bits(ranked.filter("_met"), FILE, ROW), "replaced")
                        delta = delta.unionByName(self._terms(_marked(old, replaced, FILE, ROW, True), -1))
            stored = self._save_terms(delta, commit, folder)
            if held:
                kept = _marked(old, gone, FILE, ROW, False).select(*schema_of(self.spec).names)
                needed = self._files(size + input_bytes(old), len(touched))
                if len(held) + len(done.inputFiles()) > CROWDED * needed * len(touched):
                    kept = self._placed(kept, needed)
                self._save(kept, folder)
                discard(gone, *([replaced] if self.spec.idf else []))
            buckets = commit["buckets"] | {str(row[BUCKET]): folder for row in touched}
            self.commits.put({**commit, "buckets": buckets, "terms": stored}, number)
        else:
            self.commits.delete(f"{self.path}/data/v={folder}")
        return sum(row["n"] for row in touched)

    def _rows_of(self, ids: DataFrame) -> DataFrame:
        """The stored rows of the ids, with the other columns of ``ids``; only the buckets the ids fall into are read."""
        wanted = written(ids.withColumn("id", F.col("id").cast("string")).withColumn(BUCKET, bucket_of(self.spec)), "wanted")
        buckets = [row[BUCKET] for row in wanted.select(BUCKET).distinct().collect() if row[BUCKET] is not None]
        return self._read(self._commit()[1], buckets).drop(BUCKET).join(wanted.drop(BUCKET), "id")

    def set_payload(self, ids: DataFrame, patch: Mapping[str, object]) -> int:
        """Set the same payload values on all listed points; returns how many there are.  None sets a null; vectors stay."""
        if not patch:
            raise ValueError("'payload' must not be empty")
        rows = self._rows_of(ids.select("id").distinct())
        return self._merge(self._patched(rows, {k: (F.lit(True), F.lit(v)) for k, v in patch.items()}, patch), None)

    def patch_payload(self, patches: DataFrame, fields: Sequence[str], ordinal: str = "ordinal", *, clear: str | None = None) -> int:
        """Apply ``(id, ordinal, field...)`` patches (see ``fold_patches``); returns the number of points changed."""
        rows = self._rows_of(fold_patches(patches, fields, ordinal, "id", clear))
        changes = {f: (F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}").getField("value")) for f in fields}
        return self._merge(self._patched(rows, changes).drop(*[f"_new_{f}" for f in fields]), None)

    def _patched(self, rows: DataFrame, changes: Mapping[str, tuple[Column, Column]], literal: Mapping[str, object] | None = None) -> DataFrame:
        """Change declared fields in their columns and others in the JSON object, where the first of each pair holds."""
        declared = {name: dtype for name, dtype in self.spec.payload_types}
        found = rows.withColumns(
            {n: F.when(hit, value.cast(declared[n])).otherwise(F.col(f"`{n}`")) for n, (hit, value) in changes.items() if n in declared}
        )
        others = [n for n in changes if n not in declared]
        if literal is not None and others:
            found = found.withColumn(EXTRA, merge_json(F.col(EXTRA), F.lit(json.dumps({n: literal[n] for n in others}))))
        elif others:
            for name in others:
                hit, value = changes[name]
                one = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
                found = found.withColumn(EXTRA, F.when(hit, merge_json(F.col(EXTRA), one)).otherwise(F.col(EXTRA)))
        return found

    @staticmethod
    def _folder(number: int) -> str:
        # Named apart, so that a writer that fails or comes second never meets another one's files.
        return f"{number + 1}-{uuid.uuid4().hex[:8]}"

    def _files(self, size: int, buckets: int) -> int:
        """Files of each bucket, for rows that come from files of ``size`` bytes: a large bucket is written by several tasks."""
        return max(self.spec.files_per_bucket, -(-size // (buckets * PIECE_BYTES)))

    def _piece(self, files: int) -> Column:
        return (bucket_of(self.spec) * files + _share(files)).cast("int")

    def _placed(self, df: DataFrame, files: int, unique: bool = True) -> DataFrame:
        """Deal rows to the tasks that write them, by bucket and file; unless ids are unique, one row of each is taken there."""
        pieces = df.withColumn(PIECE, self._piece(files))
        placed = pieces.repartition(PIECE) if files == self.spec.files_per_bucket else pieces.repartitionById(self.spec.buckets * files, F.col(PIECE))
        if not unique:
            by = W.partitionBy(PIECE, "id").orderBy("id")
            placed = placed.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
        return placed.drop(PIECE)

    def _numbered(self, df: DataFrame, vectors: Sequence[str] | None) -> DataFrame:
        return self._shaped(df, vectors).withColumn(BUCKET, bucket_of(self.spec))

    def dense_of(self, df: DataFrame, vectors: Sequence[str] | None) -> Column:
        """The dense vector of a batch's row for this table: its own column, else the one without a name."""
        if vectors:
            return named_dense(df, self.spec, vectors)
        found = [F.col(f"`{c}`").cast("array<float>") for c in dict.fromkeys((self.spec.dense_column, DENSE)) if c in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("array<float>")

    def _sparse_of(self, df: DataFrame) -> Column:
        found = [F.col(f"`{c}`").cast(SPARSE_TYPE) for c in dict.fromkeys((self.spec.sparse_column, SPARSE)) if c in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast(SPARSE_TYPE)

    def _shaped(self, df: DataFrame, vectors: Sequence[str] | None = None) -> DataFrame:
        fields = {f.name: f for f in schema_of(self.spec) if f.name not in (BUCKET, EXTRA)}
        used = {*fields, EXTRA, BUCKET, DENSE, SPARSE, *(vectors or ())}
        others = [c for c in df.columns if c not in used]
        extra = F.col(EXTRA) if EXTRA in df.columns else F.lit(None).cast("string")
        if others:
            # Undeclared fields go into the JSON object, over fields of the same name that are there already.
            packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))
            packed = F.when(packed != "{}", packed)
            extra = merge_json(extra, packed) if EXTRA in df.columns else packed

        def value(name: str) -> Column:
            if name == self.spec.dense_column:
                return self.dense_of(df, vectors)
            if name == self.spec.sparse_column:
                return self._sparse_of(df)
            return F.col(f"`{name}`") if name in df.columns else F.lit(None)

        return df.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in fields.values()], extra.alias(EXTRA))

    def _save(self, df: DataFrame, folder: str) -> None:
        # In the order of the ids, so that a file's row groups have id ranges that tell them apart.
        writer = df.sortWithinPartitions(BUCKET, "id").write.partitionBy(BUCKET).mode("append").option("compression", "zstd")
        writer = writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        with shuffles_dropped(df.sparkSession):
            writer.parquet(f"{self.path}/data/v={folder}")

    def _saved(self, folder: str) -> DataFrame:
        """What has been written to a folder so far."""
        return self.spark.read.schema(schema_of(self.spec)).parquet(f"{self.path}/data/v={folder}")

    # --- term counts ------------------------------------------------------------------------------------

    def _terms(self, points: DataFrame, sign: int) -> DataFrame:
        """``index, df``: how many of the points have a term; -1 stands for having any."""
        indices = F.col(f"`{self.spec.sparse_column}`.indices") if self.spec.sparse_column else F.array().cast("array<int>")
        marks = F.when(F.size(indices) > 0, F.concat(F.array(F.lit(-1)), indices))
        each = points.select(F.explode(marks).alias("index"))
        return each.groupBy("index").agg((F.count("*") * sign).alias("df"))

    def _save_terms(self, delta: DataFrame, commit: dict, folder: str) -> list[str]:
        if not self.spec.idf:
            return commit["terms"]
        fold = len(commit["terms"]) + 1 >= TERM_FOLDERS
        if fold:
            delta = delta.unionByName(self._stored_terms(commit))
        with shuffles_dropped(self.spark):
            delta.groupBy("index").agg(F.sum("df").alias("df")).filter("df <> 0").write.parquet(f"{self.path}/terms/{folder}")
        return [folder] if fold else [*commit["terms"], folder]

    def _stored_terms(self, commit: dict) -> DataFrame:
        paths = [f"{self.path}/terms/{folder}" for folder in commit["terms"]]
        schema = "index int, df bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def statistics(self) -> DataFrame:
        """``(index, df, n)`` as ``term_statistics`` counts them, from the stored counts."""
        if not self.spec.idf:
            raise ValueError(f"collection {self.spec.name} keeps no term counts")
        counts = self._stored_terms(self._commit()[1]).groupBy("index").agg(F.sum("df").alias("df")).filter("df <> 0")
        counts = written(counts, "terms")
        total = counts.filter("index = -1").head()
        return counts.filter("index >= 0").withColumn("n", F.lit(total["df"] if total else 0).cast("bigint"))

    # --- upkeep -----------------------------------------------------------------------------------------

    def expire(self) -> int:
        """Delete what the newest commit does not need; returns the number of folders.  Readers of older commits lose their files."""
        number, commit = self._commit()
        needed = {f"v={folder}" for folder in commit["buckets"].values()}
        gone = [f"{self.path}/data/{name}" for name in self.commits.folders(f"{self.path}/data") if name not in needed]
        # A folder may still serve some buckets only.
        for name in self.commits.folders(f"{self.path}/data"):
            if name in needed:
                buckets = {f"{BUCKET}={b}" for b, folder in commit["buckets"].items() if f"v={folder}" == name}
                at = f"{self.path}/data/{name}"
                gone += [f"{at}/{b}" for b in self.commits.folders(at) if b.startswith(f"{BUCKET}=") and b not in buckets]
        gone += [f"{self.path}/terms/{name}" for name in self.commits.folders(f"{self.path}/terms") if name not in commit["terms"]]
        gone += [f"{self.commits.path}/{old:010d}.json" for old in self.commits.numbers() if old < number]
        for path in gone:
            self.commits.delete(path)
        return len(gone)

    def repoint(self, alias: str, tables: Sequence[str] = ()) -> bool:
        """Make ``alias`` stand for this table, here and for other sessions (see ``aliases``); skipped if it is this table's
        name or that of another collection."""
        if alias == self.spec.name or alias in tables:
            return False
        set_alias(self.spark, self.root, alias, self.spec.name)
        self.read().createOrReplaceTempView(alias)
        return True


def set_payload_all(targets: Sequence[PointTable], ids: DataFrame, patch: Mapping[str, object]) -> dict[str, int]:
    """``set_payload`` on every target; points changed per target."""
    fixed = written(ids.select("id").distinct(), "ids")
    return {target.spec.name: target.set_payload(fixed, patch) for target in targets}


def patch_payload_all(
    targets: Sequence[PointTable], patches: DataFrame, fields: Sequence[str], ordinal: str = "ordinal", *, clear: str | None = None
) -> dict[str, int]:
    """``patch_payload`` on every target; points changed per target."""
    fixed = written(patches, "patches")
    return {target.spec.name: target.patch_payload(fixed, fields, ordinal, clear=clear) for target in targets}


def _with_terms(batch: DataFrame, targets: Sequence[PointTable]) -> DataFrame:
    """Fill missing sparse vectors from the payload's ``text`` if a target has such vectors; they are the same for all."""
    if not any(t.spec.sparse_column for t in targets) or "text" not in batch.columns:
        return batch
    own = {t.spec.sparse_column for t in targets if t.spec.sparse_column} & set(batch.columns)
    return batch if own - {SPARSE} else sparse_from_payload(batch, SPARSE)


def _bits(rows: DataFrame, file: str | None, row: str) -> DataFrame:
    """Which rows of a table ``rows`` are: one bit for each row of the table, in chunks that are named by file and row number."""
    found = rows.groupBy(*([file] if file else []), F.shiftright(row, CHUNK_POWER).alias(CHUNK))
    return found.agg(F.bitmap_construct_agg(F.col(row) % (1 << CHUNK_POWER)).alias(BITS))


def _marked(table: DataFrame, bits: DataFrame, file: str | None, row: str, hit: bool) -> DataFrame:
    """The rows of a table that have a bit set, or those that have none; no row is shuffled."""
    at = F.col(row) % (1 << CHUNK_POWER)
    byte = F.conv(F.hex(F.substring(F.col(BITS), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    chunked = table.withColumn(CHUNK, F.shiftright(row, CHUNK_POWER))
    joined = chunked.join(F.broadcast(bits), [*([file] if file else []), CHUNK], "left")
    return joined.filter(is_set == hit).select(*table.columns)


def _share(n: int) -> Column:
    """One of ``n`` shares of the ids, whatever the bucket; shares of a multiple of ``n`` are parts of these."""
    return F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.lit(n)).cast("int")


def _in_parts(df: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``df`` as a table in the shared folder, and each of its parts as one that can be deleted by itself."""
    path, whole = packed(df.withColumn(PART, _share(PARTS)), "batch", PART)
    names = sorted({file.rsplit("/", 2)[-2] for file in whole.inputFiles()})
    return whole.select(*df.columns), [df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}") for name in names]


def _latest(batch: DataFrame, ordinal: str | None) -> tuple[DataFrame, list[Part], list[DataFrame]]:
    """The batch, written down as it comes, and of that the last row of each id, whole and in parts; and the tables behind it.

    Ids, ordinals and row numbers are all that is shuffled, and they combine on the map side.
    """
    whole, parts = _in_parts(batch.withColumn(ROW, F.monotonically_increasing_id()))
    last = F.max(ROW) if ordinal is None else F.max_by(ROW, F.struct(ordinal, ROW))
    with shuffles_dropped(batch.sparkSession):
        bits = written(_bits(whole.groupBy("id").agg(last.alias(ROW)), None, ROW), "last")
    names = ["id", *[c for c in batch.columns if c not in ("id", ordinal)]]
    found = [_marked(table, bits, None, ROW, True).select(*names) for table in (whole, *parts)]
    return found[0], list(zip(found[1:], parts)), [*parts, bits]


def _fixed(batch: DataFrame, targets: Sequence[PointTable], ordinal: str | None) -> tuple[DataFrame, list[DataFrame]]:
    rows, _, tables = _latest(batch, ordinal)
    whole, parts = _in_parts(_with_terms(rows, targets))
    discard(*tables)
    return whole, parts


def fixed_batch(batch: DataFrame, targets: Sequence[PointTable], ordinal: str | None) -> DataFrame:
    """The batch with one row per id, written down: its ids and vectors are the same for all targets."""
    return _fixed(batch, targets, ordinal)[0]


def _merge_all(targets: Sequence[PointTable], batch: DataFrame, parts: list[DataFrame], vectors: Sequence[str] | None) -> dict[str, int]:
    """Merge a batch that nothing else reads into every target; it is deleted."""
    pairs = [(part, part) for part in parts]
    last = len(targets) - 1
    done = {target.spec.name: target._merge(batch, vectors, pairs, used_up=at == last) for at, target in enumerate(targets)}
    discard(*parts)
    return done


def write_all(
    batch: DataFrame, targets: Sequence[PointTable], ordinal: str | None = None, *, vectors: Sequence[str] | None = None
) -> dict[str, int]:
    """Write the same rows to every target, one after the other; rows written per target.

    The batch is materialised once.  A dense vector without a name (column ``dense``) goes under each target's own name; ``vectors`` names
    the columns of a batch whose vectors have names.
    """
    return _merge_all(targets, *_fixed(batch, targets, ordinal), vectors)


def write_checked(
    batch: DataFrame, targets: Sequence[PointTable], ordinal: str | None = None, *, vectors: Sequence[str] | None = None
) -> tuple[dict[str, int], DataFrame]:
    """Like ``write_all`` for the rows in which every target finds a dense vector of its size; ``(rows written, rejected)``.

    A row that one target cannot take is written to none.  Rejected rows keep their columns and have a ``reason``.  Of rows with one id
    the last one is checked.
    """
    fixed = fixed_batch(batch, targets, ordinal)
    rules = [rule for t in targets for rule in vector_rules(t.spec, t.dense_of(fixed, vectors))]
    valid, rejected = split(fixed, rules)
    return _merge_all(targets, *_in_parts(valid), vectors), rejected


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of a few small files to all cores; a scan with enough partitions is left alone.

    For heavy per-row work (tokens, models) on inputs that fit one task.  Takes a plain scan: asking it for its
    partitions runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    # Without columns the plan to ask is the smallest one; the number of partitions is that of the files.
    return scan.repartition(cores) if scan.select(F.lit(1)).rdd.getNumPartitions() < cores else scan


# --- reading --------------------------------------------------------------------------------------------


def project(df: DataFrame, vectors: Sequence[str], with_payload: bool, with_vectors: bool) -> DataFrame:
    drop = ([] if with_vectors else [v for v in vectors if v in df.columns])
    if with_payload:
        return df.drop(*drop)
    return df.select("id", *[v for v in vectors if with_vectors and v in df.columns])


def scroll(
    points: DataFrame,
    filter: Mapping | None = None,
    limit: int = 100,
    *,
    after_id: str | None = None,
    vectors: Sequence[str] = ("dense", "sparse"),
    with_payload: bool = True,
    with_vectors: bool = False,
) -> DataFrame:
    """One page of points in id order.  ``after_id`` continues behind the last id of the page before."""
    check_limit(limit)
    rows = apply_filter(points, filter)
    if after_id is not None:
        rows = rows.filter(F.col("id") > F.lit(after_id))
    return project(rows.orderBy("id").limit(limit), vectors, with_payload, with_vectors)


def retrieve(
    points: DataFrame,
    ids: DataFrame,
    *,
    vectors: Sequence[str] = ("dense", "sparse"),
    with_payload: bool = True,
    with_vectors: bool = False,
) -> DataFrame:
    """Points with the given ids; unknown ids are silently absent.  Any number of ids."""
    wanted = ids.select(F.col("id").cast("string").alias("id"))
    return project(points, vectors, with_payload, with_vectors).join(wanted, "id", "left_semi")


def count(points: DataFrame, filter: Mapping | None = None) -> DataFrame:
    return apply_filter(points, filter).agg(F.count("*").alias("count"))


def migration_source(
    points: DataFrame, filter: Mapping | None = None, shard_key: str | None = None, shards: Sequence[str] = ()
) -> DataFrame:
    """Rows of one migration slice: filter, and the listed values of the shard key (none listed: all)."""
    rows = apply_filter(points, filter)
    return rows.filter(F.col(shard_key).isin(list(shards))) if shard_key and shards else rows
