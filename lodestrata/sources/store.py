"""A key-value table on a file system: sorted runs under a manifest log.

Layout below the table's path::

    runs/<folder>/<part>.parquet     sorted by (key, seq descending); each file is a run
    values/dir=<folder>/fid=<n>/     separated values, files of about ``value_file_bytes``
    manifest/<version>.json          one batch of actions per commit, with its checksum

A commit writes its data first, then its manifest file aside, and gives that
file its name only if no other has it; whoever comes second gets
``RejectedError`` and commits nothing.  So a manifest file is whole once it has
its name; one that is damaged all the same holds no commit.  Readers fold the
manifest, prune runs by key range and read the rest in one scan.  The manifest
lists runs and value files, a line for each ``run_bytes`` or
``value_file_bytes`` of data, and is rewritten when most lines are dead.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.kv import has_prefix, is_live, prefix_end, record_size, status
from lodestrata.model import (
    LOG, BatchTooBigError, BlockedWritesError, ChecksumError, EmptyKeyError, InvalidRequestError, KeyNotFoundError,
    MissingTableError, NoRewriteError, Options, RejectedError,
)
from lodestrata.operators import levels
from lodestrata.operators.resolve import live_state, resolve
from lodestrata.operators.skew import lookup_join
from lodestrata.session import cut

_RUN = T.StructType([*LOG.fields, T.StructField("fid", T.LongType()), T.StructField("offset", T.LongType())])
_VALUES = T.StructType([
    T.StructField("offset", T.LongType()), T.StructField("len", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("seq", T.LongType()),
    T.StructField("value", T.BinaryType()), T.StructField("checksum", T.LongType()), T.StructField("dir", T.StringType()), T.StructField("fid", T.LongType()),
])


def _run_sum():
    """Checksum of a run's entries, whatever their order."""
    return F.bit_xor(F.xxhash64(*_RUN.names))


@dataclass
class Manifest:
    """Folded manifest: live runs by name, value files by number, held snapshots, the next sequence number."""

    version: int = 0
    runs: dict[str, dict] = field(default_factory=dict)
    files: dict[int, str] = field(default_factory=dict)
    held: list[int] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    next_seq: int = 1
    next_fid: int = 0
    #: Snapshots below it are gone, unless held; versions below ``first`` are no longer readable.
    merged_seq: int = 0
    first: int = 0
    creations: int = 0
    deletions: int = 0

    def apply(self, actions: Iterable[dict]) -> None:
        for a in actions:
            kind = a["op"]
            if kind == "create":
                if a["run"]["name"] in self.runs:
                    raise InvalidRequestError(f"run exists: {a['run']['name']}")
                self.runs[a["run"]["name"]] = a["run"]
                self.next_seq = max(self.next_seq, a["run"]["max_seq"] + 1)
                self.creations += 1
            elif kind == "delete":
                if a["name"] not in self.runs:
                    raise InvalidRequestError(f"run is not live: {a['name']}")
                del self.runs[a["name"]]
                self.deletions += 1
            elif kind == "files":
                self.files.update(dict.fromkeys(a["fids"], a["dir"]))
                self.next_fid = max(self.next_fid, *(f + 1 for f in a["fids"]))
            elif kind == "drop_files":
                for f in a["fids"]:
                    self.files.pop(f, None)
            elif kind == "hold":
                self.held = sorted({*self.held, a["seq"]})
            elif kind == "release":
                self.held = [s for s in self.held if s != a["seq"]]
            elif kind == "merged":
                self.merged_seq = max(self.merged_seq, a["seq"])
            elif kind == "batch":
                self.batches[a["stream"]] = a["number"]
            elif kind == "first":
                self.first = max(self.first, a["version"])
            elif kind == "snapshot":
                s = a["state"]
                self.runs = {r["name"]: r for r in s["runs"]}
                self.files = {int(f): d for f, d in s["files"].items()}
                for name in ("held", "batches", "next_seq", "next_fid", "merged_seq", "first"):
                    setattr(self, name, s[name])
                self.creations, self.deletions = len(self.runs), 0

    def state(self) -> dict:
        names = ("files", "held", "batches", "next_seq", "next_fid", "merged_seq", "first")
        return {"runs": list(self.runs.values()), **{n: getattr(self, n) for n in names}}


class KVTable:
    """An open table. ``now`` (epoch seconds) is a parameter of every read."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.closed = False
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    # manifest

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _listed(self, folder: str) -> list:
        at = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed("manifest")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _actions(self, version: int) -> list[dict]:
        """Actions of a version; none if its file is damaged (it was never committed)."""
        text = self._read_text(f"{self.path}/manifest/{version:020d}.json")
        check, _, body = text.partition("\n")
        return json.loads(body) if check == str(zlib.crc32(body.encode())) else []

    def manifest(self, as_of_version: int | None = None) -> Manifest:
        """The live set after all commits, or after ``as_of_version``."""
        m = Manifest()
        for v in self._versions():
            if as_of_version is None or v <= as_of_version:
                m.apply(self._actions(v))
                m.version = v
        return m

    def _publish(self, version: int, body: str) -> None:
        """The file of a version, whole or not at all, unless there is one."""
        target, aside = (f"{self.path}/manifest/{n}" for n in (f"{version:020d}.json", f".{uuid.uuid4().hex}"))
        stream = self._fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(f"{zlib.crc32(body.encode())}\n{body}".encode()))
        finally:
            stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                # a local rename would replace; a link does not
                local = [self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath() for p in (target, aside)]
                self._jvm.java.nio.file.Files.createLink(*local)
            else:
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(self._path(aside), self._path(target), options)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise RejectedError(f"version {version} was committed by another writer") from None
            raise
        finally:
            self._fs.delete(self._path(aside), False)

    def _commit(self, base: Manifest, actions: list[dict]) -> None:
        if self.closed:
            raise BlockedWritesError("the table is closed")
        check = Manifest()
        check.apply([{"op": "snapshot", "state": json.loads(json.dumps(base.state()))}])
        check.creations, check.deletions = base.creations, base.deletions
        check.apply(actions)
        self._publish(base.version + 1, json.dumps(actions))
        if levels.checkpoint_due(check.creations, check.deletions, self.options):
            self.checkpoint()

    def _retry(self, action, tries: int = 20):
        """``action`` of a fresh manifest, again while other writers come first."""
        for left in range(tries - 1, -1, -1):
            try:
                return action(self.manifest())
            except RejectedError:
                if not left:
                    raise

    def checkpoint(self) -> None:
        """A commit that holds the whole live set."""
        self._retry(lambda m: self._publish(m.version + 1, json.dumps([{"op": "snapshot", "state": m.state()}])))

    # snapshots

    def hold(self) -> int:
        """A snapshot of the state so far; compaction and GC keep what it needs until it is released."""

        def one(m: Manifest) -> int:
            self._commit(m, [{"op": "hold", "seq": m.next_seq - 1}])
            return m.next_seq - 1

        return self._retry(one)

    def release(self, seq: int) -> None:
        self._retry(lambda m: self._commit(m, [{"op": "release", "seq": seq}]))

    def _kept(self, log: DataFrame, m: Manifest) -> DataFrame:
        """Of each key the newest version, and the newest at or below each held snapshot."""
        if not m.held:
            return resolve(log)
        era = sum((F.col("seq") > s).cast("int") for s in m.held)
        rank = F.row_number().over(Window.partitionBy("key", "__era").orderBy(F.col("seq").desc()))
        return log.withColumn("__era", era).withColumn("__rank", rank).where("__rank = 1").drop("__era", "__rank")

    # files on disk

    def _there(self) -> dict[str, float]:
        """Run files and value files on disk with their age in seconds."""
        now = time.time()
        out = {}
        for folder in self._listed("runs"):
            name = folder.getPath().getName()
            for f in self._listed(f"runs/{name}"):
                if f.getPath().getName().endswith(".parquet"):
                    out[f"runs/{name}/{f.getPath().getName()}"] = now - f.getModificationTime() / 1000
        for folder in self._listed("values"):
            name = folder.getPath().getName()
            for f in self._listed(f"values/{name}"):
                if f.getPath().getName().startswith("fid="):
                    out[f"values/{name}/{f.getPath().getName()}"] = now - f.getModificationTime() / 1000
        return out

    @staticmethod
    def _named(m: Manifest) -> set[str]:
        return {f"runs/{r}" for r in m.runs} | {f"values/dir={d}/fid={f}" for f, d in m.files.items()}

    def orphans(self) -> tuple[list[str], list[str]]:
        """(files on disk that are not live, live files that are not on disk)."""
        there, live = set(self._there()), self._named(self.manifest())
        return sorted(there - live), sorted(live - there)

    def clean(self, retain: int = 0, grace_seconds: float = 3600) -> list[str]:
        """Delete run and value files that the last ``retain`` + 1 versions do not need.

        Files younger than ``grace_seconds`` may belong to a writer that has not
        committed yet and stay.  Older versions become unreadable.  A live file
        that is missing is an error.
        """
        m, needed = Manifest(), set()
        versions = self._versions()
        first = versions[max(0, len(versions) - 1 - retain)] if versions else 0
        for v in versions:
            m.apply(self._actions(v))
            m.version = v
            if v >= first:
                needed |= self._named(m)
        there = self._there()
        missing = sorted(self._named(m) - set(there))
        if missing:
            raise MissingTableError(", ".join(missing))
        gone = sorted(f for f, age in there.items() if f not in needed and age >= grace_seconds)
        if gone:
            self._commit(m, [{"op": "first", "version": first}])
            for name in gone:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone

    # writes

    def _separate(self, rows: DataFrame, m: Manifest) -> tuple[DataFrame, list[dict]]:
        """Large values of ``rows`` written to value files; the rows with pointers in their place, and the actions."""
        large = F.col("value").isNotNull() & F.col("fid").isNull() & (F.octet_length("value") >= self.options.value_threshold)
        size = record_size(F.octet_length("key"), F.octet_length("value"), F.coalesce("expires_at", F.lit(0))).cast("long")
        values = rows.where(large).withColumn("len", size)
        total = values.agg(F.sum("len")).first()[0]
        if not total:
            return rows, []
        n, folder = -(-total // self.options.value_file_bytes), uuid.uuid4().hex
        placed = values.repartition(n, F.xxhash64("key", "seq")).sortWithinPartitions("seq")
        placed = placed.withColumn("fid", F.spark_partition_id().cast("long") + m.next_fid)
        placed = placed.withColumn("offset", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))  # the record's place in its file
        placed = placed.select("offset", "len", "key", "seq", "value", F.xxhash64("key", "value").alias("checksum"), "fid")
        placed.write.partitionBy("fid").parquet(f"{self.path}/values/dir={folder}")
        fids = sorted(int(s.getPath().getName()[4:]) for s in self._listed(f"values/dir={folder}") if s.getPath().getName().startswith("fid="))
        at = self._value_files({f: folder for f in fids}).select("key", "seq", F.col("fid").alias("__fid"), F.col("offset").alias("__offset"))
        rows = rows.join(at, ["key", "seq"], "left").select(
            "key", "seq", "is_delete", F.when(F.col("__fid").isNull(), F.col("value")).alias("value"), "expires_at", "meta",
            F.coalesce("fid", "__fid").alias("fid"), F.coalesce("offset", "__offset").alias("offset"),
        )
        return rows, [{"op": "files", "dir": folder, "fids": fids}]

    def _write_runs(self, log: DataFrame, level: int, m: Manifest) -> list[dict]:
        """Write ``log`` as sorted runs of about the level's run size; large values go to value files. Returns the actions."""
        rows = log
        for c in ("fid", "offset"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("long"))
        rows, actions = self._separate(rows.select(*_RUN.names), m)
        total = rows.agg(F.sum(self._run_size())).first()[0]
        if not total:
            return actions
        wanted = max(levels.run_bytes(level, self.options), 1)
        by = [F.col("key"), F.col("seq").desc()]
        folder = f"l{level}-{uuid.uuid4().hex}"
        (
            rows.repartitionByRange(-(-total // wanted), *by).sortWithinPartitions(*by).write.option("parquet.bloom.filter.enabled#key", "true")
            .option("parquet.bloom.filter.fpp#key", str(self.options.bloom_fpp)).parquet(f"{self.path}/runs/{folder}")
        )
        back = self.spark.read.schema(_RUN).parquet(f"{self.path}/runs/{folder}")
        for s in back.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("n"), F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"), F.max("seq").alias("max_seq"),
            F.sum(self._run_size()).alias("size"), _run_sum().alias("sum"), F.min("fid").alias("min_fid"), F.max("fid").alias("max_fid"),
        ).collect():  # a row per run
            run = {"name": f"{folder}/{s['file']}", "level": level, "created": int(time.time()), **{c: s[c] for c in ("n", "lo", "hi", "max_seq", "size", "sum", "min_fid", "max_fid")}}
            actions.append({"op": "create", "run": run})
        return actions

    @staticmethod
    def _run_size():
        return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(12))

    def write(self, log: DataFrame, level: int = 0, batch: tuple[str, int] | None = None) -> bool:
        """Append a change log (schema ``LOG``, seq given by the caller) as one commit.

        ``batch``: (stream, number) of a micro-batch; one that was committed
        before is not written again.  Returns whether something was committed.
        """
        bad = log.where(F.col("key").isNull() | (F.octet_length("key") == 0) | (F.octet_length("key") > self.options.max_key_bytes))
        if not bad.isEmpty():
            raise EmptyKeyError("null, empty or too long key")
        rows = log.select(*[F.col(f.name).cast(f.dataType) for f in LOG.fields])

        def one(m: Manifest) -> bool:
            if batch and m.batches.get(batch[0], -1) >= batch[1]:
                return False
            actions = self._write_runs(rows, level, m)
            if batch:
                actions.append({"op": "batch", "stream": batch[0], "number": batch[1]})
            if actions:
                self._commit(m, actions)
            return bool(actions)

        return self._retry(one)

    def batch(self, entries: Sequence[tuple[bytes, bytes | None, int]], deletes: Sequence[bytes] = ()) -> None:
        """Puts (key, value, expires_at) and deletes as one commit, numbered in order after all that were committed before."""
        rows = [(bytes(k), None if v is None else bytes(v), e, False) for k, v, e in entries]
        rows += [(bytes(k), None, 0, True) for k in deletes]
        if any(not k or len(k) > self.options.max_key_bytes for k, *_ in rows):
            raise EmptyKeyError("null, empty or too long key")
        if len(rows) >= self.options.max_batch_count or sum(len(k) + len(v or b"") for k, v, *_ in rows) >= self.options.max_batch_size:
            raise BatchTooBigError(f"{len(rows)} entries")

        def one(m: Manifest) -> None:
            # numbered from the manifest it is committed on, anew if another writer was first
            numbered = [(k, m.next_seq + i, d, v, e, 0) for i, (k, v, e, d) in enumerate(rows)]
            actions = self._write_runs(self.spark.createDataFrame(numbered, LOG), 0, m)
            if actions:
                self._commit(m, actions)

        self._retry(one)

    def put(self, key: bytes, value: bytes, expires_at: int = 0) -> None:
        self.batch([(key, value, expires_at)])

    def delete(self, key: bytes) -> None:
        self.batch([], [key])

    # reads

    def _value_files(self, files: dict[int, str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], _VALUES)
        paths = [f"{self.path}/values/dir={d}/fid={f}" for f, d in sorted(files.items())]
        return self.spark.read.schema(_VALUES).option("basePath", f"{self.path}/values").parquet(*paths)

    def _read(self, names: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/runs/{n}" for n in names]
        return self.spark.read.schema(_RUN).parquet(*paths) if paths else self.spark.createDataFrame([], _RUN)

    def log(self, lo: bytes | None = None, hi: bytes | None = None, as_of_version: int | None = None, m: Manifest | None = None) -> DataFrame:
        """The change log of the live runs whose key range meets [lo, hi]."""
        m = m or self.manifest()
        if as_of_version is not None:
            if as_of_version < m.first:
                raise InvalidRequestError(f"version {as_of_version} was cleaned")
            m = self.manifest(as_of_version)
        return self._read(
            n for n, r in m.runs.items() if (lo is None or bytes.fromhex(r["hi"]) >= lo) and (hi is None or bytes.fromhex(r["lo"]) <= hi)
        )

    def _with_values(self, state: DataFrame, m: Manifest, fids: set[int] | None = None) -> DataFrame:
        files = m.files if fids is None else {f: m.files[f] for f in fids if f in m.files}
        if not files:
            return state.select(*LOG.names)
        far = self._value_files(files).select("fid", "offset", F.col("value").alias("__far"))
        return state.join(far, ["fid", "offset"], "left").withColumn("value", F.coalesce("value", "__far")).select(*LOG.names)

    def scan(
        self, now: int, *, prefix: bytes | None = None, start: bytes | None = None, end: bytes | None = None,
        as_of_seq: int | None = None, values: bool = True,
    ) -> DataFrame:
        """Live entries in a key range (order them as needed); without ``values`` the value files stay unread.

        ``as_of_seq``: the state after that sequence number.  Once a compaction
        has merged later versions it must be held (``hold``), else the request is refused.
        """
        m = self.manifest()
        if as_of_seq is not None and as_of_seq < m.merged_seq and as_of_seq not in m.held:
            raise InvalidRequestError(f"versions up to {m.merged_seq} were merged and {as_of_seq} is not held")
        lo, hi = start, end
        if prefix:
            lo = max(lo or b"", prefix)
            stop = prefix_end(prefix)
            hi = min(hi, stop) if hi and stop else hi or stop
        log = self.log(lo, hi, m=m)
        if prefix:
            log = log.where(has_prefix(F.col("key"), prefix))
        if start is not None:
            log = log.where(F.col("key") >= F.lit(start))
        if end is not None:
            log = log.where(F.col("key") < F.lit(end))
        state = live_state(log, now, as_of=as_of_seq)
        return self._with_values(state, m) if values else state.select("key", "seq", "expires_at", "meta")

    def multi_get(self, keys: DataFrame, now: int) -> DataFrame:
        """(key, seq, value, status) of each distinct key of ``keys``: 'found', 'deleted', 'expired' or 'not_found'."""
        m = self.manifest()
        wanted = cut(keys.select(F.col("key").cast("binary").alias("key")).where("key is not null").distinct())
        newest = resolve(lookup_join(self.log(m=m), wanted, "key", salt_on=["seq"])).withColumn("__status", status(now))
        found = self._with_values(newest.where("__status = 'live'").drop("__status"), m).select("key", F.col("seq").alias("seq"), "value")
        told = newest.select("key", F.when(F.col("__status") == "live", "found").otherwise(F.col("__status")).alias("status"))
        out = wanted.join(told, "key", "left").join(found, "key", "left")
        return out.select("key", "seq", "value", F.coalesce("status", F.lit("not_found")).alias("status"))

    def get(self, key: bytes, now: int) -> bytes:
        """The live value of ``key``; ``KeyNotFoundError`` if there is none. Reads the runs that may hold it and one value file."""
        if not key:
            raise EmptyKeyError("null or empty key")
        m = self.manifest()
        rows = live_state(self.log(key, key, m=m).where(F.col("key") == F.lit(key)), now).collect()
        if not rows:
            raise KeyNotFoundError(key)
        if rows[0]["fid"] is None:
            return None if rows[0]["value"] is None else bytes(rows[0]["value"])
        far = self._value_files({rows[0]["fid"]: m.files[rows[0]["fid"]]}).where(F.col("offset") == rows[0]["offset"])
        value, intact = far.select("value", F.xxhash64("key", "value") == F.col("checksum")).first()
        if not intact:
            raise ChecksumError(key)
        return bytes(value)

    def stats(self, now: int) -> DataFrame:
        """Per level: runs, entries and bytes, and how many entries are live, deleted, expired or shadowed by a newer version."""
        m = self.manifest()
        meta = self.spark.createDataFrame([(r["level"], n, r["n"], r["size"]) for n, r in m.runs.items()], "level int, name string, n bigint, size bigint")
        total = meta.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("entries"), F.sum("size").alias("bytes"))
        each = self.log(m=m).withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        name = F.element_at(F.split("name", "/"), -1).alias("name")
        each = lookup_join(each, meta.select(name, "level"), "name", salt_on=["seq"])
        top = Window.partitionBy("key").orderBy(F.col("seq").desc())
        kind = F.when(F.row_number().over(top) > 1, "shadowed").otherwise(status(now))
        counts = each.withColumn("kind", kind).groupBy("level").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("live", "deleted", "expired", "shadowed")])
        return total.join(counts, "level", "left")

    # maintenance

    def _runs(self, m: Manifest) -> list[levels.Run]:
        return [
            levels.Run(r["name"], r["level"], bytes.fromhex(r["lo"]), bytes.fromhex(r["hi"]), r["size"], r["max_seq"], r["created"])
            for r in m.runs.values()
        ]

    def plan(self, now: int, busy: Sequence[tuple[bytes, bytes]] = ()) -> tuple[list[levels.Run], int]:
        """(runs to merge, level of the result) of the most urgent compaction; ``busy`` key ranges are left alone."""
        runs = self._runs(self.manifest())
        by_level = [sorted((r for r in runs if r.level == i), key=lambda r: r.max_seq) for i in range(self.options.levels)]
        sizes = [sum(r.size for r in rs) for rs in by_level]
        for todo in levels.l0_first(levels.priorities(sizes, len(by_level[0]), self.options)):
            if todo.level == 0:
                target = levels.targets(sizes, self.options).base
                top, bottom = levels.pick_l0(by_level[0], by_level[target], busy)
                if not top:  # the base is busy: merge small runs among themselves
                    top, target = levels.pick_l0_to_l0(by_level[0], levels.run_bytes(0, self.options), now), 0
            else:
                target = todo.level + 1
                top, bottom = levels.pick_level(by_level[todo.level], by_level[target], busy)
            if top:
                return (top if target == 0 else top + bottom), target
        return [], 0

    def compact(self, now: int, force: bool = False, busy: Sequence[tuple[bytes, bytes]] = ()) -> bool:
        """One compaction if a level calls for it (``force``: all levels into the last one, also what lies there)."""
        m = self.manifest()
        inputs, target = (self._runs(m), self.options.levels - 1) if force else self.plan(now, busy)
        if not inputs:
            return False
        names = {r.name for r in inputs}
        merged = self._kept(self._read(sorted(names)), m)
        # a tombstone or expired entry may go only if no other run and no snapshot can need it
        others = [r for r in self._runs(m) if r.name not in names]
        if not m.held and not any(levels.overlapping(others, r.lo, r.hi) for r in inputs):
            merged = merged.where(is_live(now))
        actions = [{"op": "delete", "name": n} for n in sorted(names)] + self._write_runs(merged, target, m)
        self._commit(m, [*actions, {"op": "merged", "seq": max(r.max_seq for r in inputs)}])
        return True

    def garbage(self, now: int, sample: float = 1.0, m: Manifest | None = None) -> DataFrame:
        """(fid, total, dead): bytes of each value file and those no visible entry points to, of a ``sample`` share of its records."""
        m = m or self.manifest()
        values = self._value_files(m.files).select("fid", "offset", "len", "key", "seq")
        if sample < 1:
            values = values.where(F.pmod(F.xxhash64("key", "seq"), F.lit(1 << 20)) < F.lit(int(sample * (1 << 20))))
        used = self._kept(self.log(m=m), m).where(F.col("fid").isNotNull() & is_live(now)).select("fid", "offset", F.lit(True).alias("used"))
        both = values.join(used, ["fid", "offset"], "left").groupBy("fid")
        return both.agg(F.sum("len").alias("total"), F.sum(F.when(F.col("used"), 0).otherwise(F.col("len"))).alias("dead"))

    def gc(self, ratio: float, now: int, sample: float = 1.0) -> list[int]:
        """Move the live values out of value files whose dead share reaches ``ratio`` and drop the files; returns them.

        Only runs that point into such files are rewritten, in their levels.
        ``clean`` then frees the space.  With ``sample`` below 1 the share is
        estimated from so much of each file's records.
        """
        if not 0 < ratio < 1 or not 0 < sample <= 1:
            raise InvalidRequestError("ratio must lie between 0 and 1, sample above 0 and at most 1")
        m = self.manifest()
        victims = [r[0] for r in self.garbage(now, sample, m).where(F.col("dead") >= F.lit(ratio) * F.col("total")).select("fid").collect()]
        if not victims:
            raise NoRewriteError("no file has so much garbage")
        lo, hi = min(victims), max(victims)
        maybe = [n for n, r in m.runs.items() if r["min_fid"] is not None and r["min_fid"] <= hi and lo <= r["max_fid"]]
        gone = cut(self.spark.createDataFrame([(f,) for f in victims], "fid bigint"))
        pointing = lookup_join(self._read(maybe).select("fid", F.col("_metadata.file_path").alias("file")), gone, "fid").select("file").distinct()
        ends = {r[0].rsplit("/", 2)[-2] + "/" + r[0].rsplit("/", 2)[-1] for r in pointing.collect()}  # names of runs
        hit = [n for n in maybe if n in ends]
        actions = [{"op": "drop_files", "fids": sorted(victims)}]
        rows = self._read(hit)
        level_of = {n: m.runs[n]["level"] for n in hit}
        needed = self._kept(self.log(m=m), m).select("key", "seq", F.lit(True).alias("__needed"))
        drop = F.lit(True).alias("__gone")
        for level in sorted(set(level_of.values())):
            rows = self._read(n for n in hit if level_of[n] == level)
            marked = lookup_join(rows, gone.select("fid", drop), "fid", how="left", salt_on=["seq"]).select(*_RUN.names, "__gone")
            stay = marked.where("__gone is null").drop("__gone")
            moved = marked.where("__gone").drop("__gone").join(needed, ["key", "seq"], "left_semi")  # what a newer version hides goes
            alive = self._with_values(moved.where(is_live(now)), m, set(victims)).withColumns({"fid": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
            # an expired entry still hides older versions: a tombstone without a value
            dead = moved.where(~is_live(now)).withColumns({"is_delete": F.lit(True), "value": F.lit(None).cast("binary"), "fid": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
            new = self._write_runs(stay.unionByName(alive).unionByName(dead), level, m)
            m.next_fid = max([m.next_fid, *(f + 1 for a in new if a["op"] == "files" for f in a["fids"])])
            actions += [{"op": "delete", "name": n} for n in hit if level_of[n] == level] + new
        self._commit(m, [*actions, {"op": "merged", "seq": max((m.runs[n]["max_seq"] for n in hit), default=0)}])
        return victims

    def drop_prefixes(self, prefixes: Sequence[bytes]) -> bool:
        """Remove all versions of the keys with one of the prefixes; rewrites only the runs that may hold such keys."""
        m = self.manifest()
        ends = [(p, prefix_end(p)) for p in prefixes]
        hit = [n for n, r in m.runs.items() if any(bytes.fromhex(r["hi"]) >= p and (e is None or bytes.fromhex(r["lo"]) < e) for p, e in ends)]
        actions = []
        for level in sorted({m.runs[n]["level"] for n in hit}):
            mine = [n for n in hit if m.runs[n]["level"] == level]
            rows = self._read(mine)
            for p in prefixes:
                rows = rows.where(~has_prefix(F.col("key"), p))
            actions += [{"op": "delete", "name": n} for n in mine] + self._write_runs(rows, level, m)
        if actions:
            self._commit(m, actions)
        return bool(actions)

    def verify(self) -> DataFrame:
        """(what, name): runs and separated values whose bytes do not match their checksum."""
        m = self.manifest()
        meta = self.spark.createDataFrame([(n.rsplit("/", 1)[-1], n, r["sum"], r["n"]) for n, r in m.runs.items()], "file string, name string, sum bigint, n bigint")
        now = self.log(m=m).groupBy(F.col("_metadata.file_name").alias("file")).agg(_run_sum().alias("s"), F.count(F.lit(1)).alias("c"))
        runs = meta.join(now, "file", "left").where("s is null or s <> sum or c <> n").select(F.lit("run").alias("what"), "name")
        bad = self._value_files(m.files).where(F.xxhash64("key", "value") != F.col("checksum"))
        return runs.unionByName(bad.select(F.lit("value").alias("what"), F.concat_ws(":", "fid", "offset").alias("name")))

    def close(self) -> None:
        """No more commits through this handle."""
        self.closed = True
