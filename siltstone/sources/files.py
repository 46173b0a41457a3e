"""Reading files: census of a tree, delimited text with a sniffed separator, and headers of binary formats.

Whole-file work goes through ``binaryFile`` and parsers over Arrow batches; formats Spark reads itself are left to it."""

from __future__ import annotations

import io
import json
import math
import re
import sqlite3
import struct
import tarfile
import tempfile
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = ",\t;|"


def relative_path(root: str):
    """The path of a file below ``root`` as a Column over ``path``."""
    base = root.removeprefix("file://").rstrip("/")
    return F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", "")


# names of folders that hold nothing of a repository's own, and are left out unless asked for
PRUNED = (".git", ".hg", ".svn", "__pycache__", ".venv", "node_modules", ".tox", ".mypy_cache", ".pytest_cache")


def matches(rel, signatures: list[str]):
    """Does a path match any signature: a suffix ('.py'), a name ('Makefile', or a folder 'docs/'), or a pattern ('re:…')?"""
    name, out = F.regexp_extract(rel, r"([^/]*)$", 1), F.lit(False)
    for s in signatures:
        if s.startswith("re:"):
            out |= rel.rlike(s[3:])
        elif s.endswith("/"):
            out |= F.concat(F.lit("/"), rel).contains("/" + s)
        elif s.startswith("."):
            out |= F.lower(name).endswith(s.lower())
        else:
            out |= name == s
    return out


def census(spark: SparkSession, root: str, exclude: str | None = None, only: list[str] | None = None, without: list[str] | None = None, pruned: tuple[str, ...] = PRUNED, hashed: int | None = None) -> DataFrame:
    """(rel_path, name, suffix, size, modified, sha256) of all files below ``root`` outside ``pruned`` folders.

    ``exclude`` is a pattern on rel_path; ``only`` and ``without`` are signatures (see ``matches``). What is left out is not opened; files of
    more than ``hashed`` bytes have a null hash and aren't either."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = relative_path(root)
    keep = ~F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, pruned))) if pruned else F.lit(True)
    for cond in ([~rel.rlike(exclude)] if exclude else []) + ([matches(rel, only)] if only else []) + ([~matches(rel, without)] if without else []):
        keep &= cond
    f = f.where(keep)
    cols = [rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if hashed is None:
        f = f.select(*cols, F.sha2("content", 256).alias("sha256"))
    else:
        f = f.where(F.col("length") <= hashed).select(*cols, F.sha2("content", 256).alias("sha256")).unionByName(f.where(F.col("length") > hashed).select(*cols, F.lit(None).cast("string").alias("sha256")))
    f = f.withColumn("name", F.regexp_extract("rel_path", r"([^/]*)$", 1)).withColumn("suffix", F.lower(F.regexp_extract("name", r"[^.](\.[^.]+)$", 1)))
    return f.select("rel_path", "name", "suffix", "size", "modified", "sha256")


def folders_and_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders, files) with ids in the order of their paths: the root folder is 1 and has no parent."""
    parts = F.split("rel_path", "/")
    names = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder_name")).distinct()
    # ids follow a total order of paths: folders are counted by range partitions, not in one window
    ids = ordered_ids(names, "folder_name", "folder_id")
    up = F.when(F.col("folder_name") == "", None).otherwise(F.regexp_replace("folder_name", r"/?[^/]*$", ""))
    folders = ids.withColumn("up", up).join(ids.select(F.col("folder_name").alias("up"), F.col("folder_id").alias("parent_folder_id")), "up", "left").select("folder_id", "folder_name", "parent_folder_id")
    f = ordered_ids(files, "rel_path", "file_id").withColumn("folder_name", F.regexp_replace("rel_path", r"/?[^/]*$", ""))
    return folders, f.join(folders.select("folder_name", "folder_id"), "folder_name").select("file_id", "rel_path", "name", "suffix", "size", "folder_id")


def ordered_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Consecutive ids from 1 by the order of ``key``: range partitions, their sizes summed up, and a window in each."""
    p = df.repartitionByRange(F.col(key)).withColumn("__p", F.spark_partition_id())
    sizes = p.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "base")
    return p.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(key))).join(F.broadcast(before), "__p").withColumn(name, F.col("base") + F.col("__r")).drop("__p", "__r", "base")


def sniff(sample: str) -> str:
    """The separator whose number per line is most even over the first lines, and not zero."""
    lines = [x for x in sample.splitlines()[:20] if x.strip()]
    score = {s: (min(n := [x.count(s) for x in lines] or [0]), -np.std(n)) for s in SEPARATORS}
    return max(score, key=lambda s: score[s])


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, schema: str | None = None) -> DataFrame:
    """Delimited text with a header; lines that don't fit are dropped. The separator is taken from the first lines."""
    if separator is None:
        separator = sniff("\n".join(r[0] for r in spark.read.text(path).limit(20).collect()))
    r = spark.read.option("header", True).option("sep", separator).option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": read_delimited, ".tsv": read_delimited, ".parquet": lambda s, p: s.read.parquet(p), ".orc": lambda s, p: s.read.orc(p),
    ".json": lambda s, p: s.read.option("multiLine", True).json(p), ".jsonl": lambda s, p: s.read.json(p), ".ndjson": lambda s, p: s.read.json(p), ".txt": lambda s, p: s.read.text(p),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """By suffix. An unknown suffix is an error."""
    suffix = re.search(r"\.[^./]+$", path.rstrip("/"))
    if not suffix or suffix[0].lower() not in READERS:
        raise ValueError(f"no reader for {path}")
    return READERS[suffix[0].lower()](spark, path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A table of a SQL store; with ``column`` and its bounds it is read by ranges at once."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column and bounds:
        r = r.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes], list[tuple]], schema: str, glob: str | None = None) -> DataFrame:
    """(path, *schema): rows of a parser of whole files. A file that isn't of the format gives no rows."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rows += [(p, *r) for r in parser(bytes(c))]
                except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, tarfile.TarError, sqlite3.Error, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=["path", *names], dtype=object)

    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


TENSORS = "tensor_name string, dtype string, shape array<long>, num_elements long, num_bytes long"


def _tensor(name: str, dtype: str, shape: list[int], width: int) -> tuple:
    n = math.prod(shape)
    return name, dtype, shape, n, n * width


def npy(content: bytes) -> list[tuple]:
    f = io.BytesIO(content)
    version = np.lib.format.read_magic(f)
    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return [_tensor("array", str(dtype), list(shape), dtype.itemsize)]


def npz(content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(n.removesuffix(".npy"), *npy(z.read(n))[0][1:]) for n in z.namelist() if n.endswith(".npy")]


def safetensors(content: bytes) -> list[tuple]:
    n = struct.unpack("<Q", content[:8])[0]
    head = json.loads(content[8 : 8 + n])
    width = {"F64": 8, "I64": 8, "U64": 8, "F32": 4, "I32": 4, "U32": 4, "F16": 2, "BF16": 2, "I16": 2, "U16": 2, "I8": 1, "U8": 1, "BOOL": 1}
    return [_tensor(k, v["dtype"], v["shape"], width[v["dtype"]]) for k, v in head.items() if k != "__metadata__"]


def archive_members(content: bytes, depth: int = 3, prefix: str = "") -> list[tuple]:
    """(member, size, depth) of zip and tar archives, and of those inside them."""
    out = []
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            items = [(i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()]
            for name, size, load in items:
                out.append((prefix + name, size, prefix.count("!")))
                if depth > 1 and re.search(r"\.(?:zip|jar|tar|tgz|tar\.gz)$", name):
                    out += archive_members(load(), depth - 1, f"{prefix}{name}!")
        return out
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for i in t.getmembers():
            if i.isfile():
                out.append((prefix + i.name, i.size, prefix.count("!")))
                if depth > 1 and re.search(r"\.(?:zip|jar|tar|tgz|tar\.gz)$", i.name):
                    out += archive_members(t.extractfile(i).read(), depth - 1, f"{prefix}{i.name}!")
    return out


def sqlite_columns(content: bytes) -> list[tuple]:
    """(table, column, type, primary key, rows) of a SQLite file."""
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        f.write(content)
        f.flush()
        con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            out = []
            for (t,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                q = '"' + t.replace('"', '""') + '"'
                n = con.execute(f"SELECT count(*) FROM {q}").fetchone()[0]
                out += [(t, c[1], c[2], bool(c[5]), n) for c in con.execute(f"PRAGMA table_info({q})").fetchall()]
            return out
        finally:
            con.close()


def media(content: bytes) -> list[tuple]:
    """(format, width, height, channels, rate, seconds) of PNG, GIF, BMP, JPEG and WAV headers."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, _, kind = struct.unpack(">IIBB", content[16:26])
        return [("png", w, h, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind), None, None)]
    if content[:4] == b"GIF8":
        return [("gif", *struct.unpack("<HH", content[6:10]), None, None, None)]
    if content[:2] == b"BM":
        return [("bmp", *struct.unpack("<ii", content[18:26]), None, None, None)]
    if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
        ch, rate, byte_rate = struct.unpack("<HII", content[22:32])
        at = content.find(b"data")
        return [("wav", None, None, ch, rate, struct.unpack("<I", content[at + 4 : at + 8])[0] / byte_rate)]
    if content[:2] == b"\xff\xd8":
        i = 2
        while i < len(content) - 9:
            n = struct.unpack(">H", content[i + 2 : i + 4])[0]
            if 0xC0 <= content[i + 1] <= 0xC3:
                h, w, c = struct.unpack(">HHB", content[i + 5 : i + 10])
                return [("jpeg", w, h, c, None, None)]
            i += 2 + n
    return []


def geo_bounds(content: bytes) -> list[tuple]:
    """(features, min x, min y, max x, max y) of GeoJSON."""
    xs: list[float] = []
    ys: list[float] = []

    def walk(c) -> None:
        if c and isinstance(c[0], (int, float)):
            xs.append(c[0])
            ys.append(c[1])
        else:
            for v in c:
                walk(v)

    g = json.loads(content)
    feats = g["features"] if g.get("type") == "FeatureCollection" else [g]
    for f in feats:
        walk((f.get("geometry") or f).get("coordinates", []))
    return [(len(feats), min(xs), min(ys), max(xs), max(ys))] if xs else []


def mesh_bounds(content: bytes) -> list[tuple]:
    """(vertices, faces, lowest and highest corner) of an OBJ mesh."""
    t = content.decode("utf-8", "replace")
    v = np.array([[float(x) for x in m.split()[1:4]] for m in re.findall(r"(?m)^v\s.*$", t)])
    faces = len(re.findall(r"(?m)^f\s", t))
    return [(len(v), faces, v.min(0).tolist(), v.max(0).tolist())] if len(v) else []


def sequences(content: bytes) -> list[tuple]:
    """(name, length, share of G and C) of FASTA and FASTQ records."""
    t = content.decode("ascii", "replace")
    if t[:1] == "@":
        lines = t.splitlines()
        recs = [(lines[i][1:], lines[i + 1]) for i in range(0, len(lines) - 3, 4)]
    else:
        recs = [(p.split("\n", 1)[0], "".join(p.split("\n")[1:])) for p in t.split(">") if p.strip()]
    return [(n.split(" ")[0].strip(), len(s), (s.upper().count("G") + s.upper().count("C")) / len(s) if s else 0.0) for n, s in recs]


def edge_list(content: bytes) -> list[tuple]:
    """(nodes, edges, density) of an edge list."""
    edges = {tuple(x.split()[:2]) for x in content.decode("utf-8", "replace").splitlines() if x.strip() and x[0] not in "#%" and len(x.split()) >= 2}
    n = len({v for e in edges for v in e})
    return [(n, len(edges), len(edges) / (n * (n - 1)) if n > 1 else 0.0)]


def byte_entropy(content: bytes) -> float:
    n = len(content)
    return round(-sum(c / n * math.log2(c / n) for c in Counter(content).values()), 4) if n else 0.0


def forensics(content: bytes) -> list[tuple]:
    """(size, entropy, printable share, strings of four and more characters, high entropy)"""
    e = byte_entropy(content)
    printable = sum(32 <= c < 127 or c in (9, 10, 13) for c in content) / max(1, len(content))
    return [(len(content), e, round(printable, 4), len(re.findall(rb"[\x20-\x7e]{4,}", content)), e >= 7.5 and len(content) > 4096)]
