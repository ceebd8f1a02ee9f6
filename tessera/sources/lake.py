"""Versioned dataset lake.

Layout: ``<base>/<dataset slug>/v_<YYYYmmdd_HHMMSS[_n]>.<format>/`` -- one
folder per version, written by Spark (Parquet by default; CSV, JSON and text
too).  The catalog is a small DataFrame built from a Hadoop FileSystem
listing (one row per version).  Names are validated by path components,
never by string prefix.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "text", "zip")
# Dataset folders hidden from listings.
HIDDEN_DATASETS = ("monitoring",)
# CSV encodings offered for uploads, and Spark's names of them.
CSV_ENCODINGS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252",
                 "utf-16": "UTF-16", "ascii": "US-ASCII"}


class LakeError(ValueError):
    pass


_UNSAFE = re.compile(r"[^\w-]")


def slugify_name(value: str, default: str = "dataset") -> str:
    """I14 for a folder name: anything but a word character or '-' becomes '_',
    underscores at either end go, and nothing left means ``default``."""
    return re.sub(_UNSAFE, "_", value.strip()).strip("_") or default


def version_key(name: str) -> tuple[str, int, str]:
    """Sort key of a version name: its stamp, then the counter of saves within
    the same stamp as a number, so save 10 follows save 9."""
    stamp = re.match(r"v_\d{8}_\d{6}", name)
    rest = name[stamp.end():] if stamp else name
    counter = re.match(r"_(\d+)(?=\.|\Z)", rest)
    return (stamp.group() if stamp else name, int(counter.group(1)) if counter else 1, name)


class Lake:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- names and paths
    def _check(self, name: str) -> str:
        if not name or ".." in name or "/" in name or "\\" in name:
            raise LakeError(f"invalid name: {name!r}")
        return name

    def _dataset_dir(self, dataset: str) -> str:
        slug = slugify_name(self._check(dataset))
        path = posixpath.normpath(posixpath.join(self.base, slug))
        base_parts = posixpath.normpath(self.base).split("/")
        if path.split("/")[:len(base_parts)] != base_parts:
            raise LakeError(f"path escapes the lake: {dataset!r}")
        return path

    def _exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._Path(path)))

    # -- write (A07, A16)
    def save(self, df: DataFrame, dataset: str, fmt: str = "parquet", version: str | None = None,
             **options) -> str:
        if fmt not in FORMATS or fmt == "zip":
            raise LakeError(f"unsupported format {fmt}")
        d = self._dataset_dir(dataset)
        version = version or dt.datetime.utcnow().strftime("v_%Y%m%d_%H%M%S")
        self._check(version)
        name, n = f"{version}.{fmt}", 1
        while self._exists(f"{d}/{name}"):
            n += 1
            name = f"{version}_{n}.{fmt}"
        w = df.write.mode("errorifexists")
        if fmt == "csv":
            w = w.option("header", options.pop("header", True))
        for k, v in options.items():
            w = w.option(k, v)
        if fmt == "text":
            w.text(f"{d}/{name}")
        else:
            w.format(fmt).save(f"{d}/{name}")
        return name

    def save_file(self, source: str, dataset: str, version: str | None = None) -> str:
        """A07 for an upload: copy one raw file (csv, json, parquet, text, zip) as a version."""
        src = self._Path(source)
        fmt = src.getName().rsplit(".", 1)[-1].lower()
        fmt = "text" if fmt == "txt" else fmt
        if fmt not in FORMATS:
            raise LakeError(f"unsupported format {fmt}")
        d = self._dataset_dir(dataset)
        version = self._check(version or dt.datetime.utcnow().strftime("v_%Y%m%d_%H%M%S"))
        name, n = f"{version}.{fmt}", 1
        while self._exists(f"{d}/{name}"):
            n += 1
            name = f"{version}_{n}.{fmt}"
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(src.getFileSystem(conf), src, self._fs, self._Path(f"{d}/{name}"), False, conf)
        return name

    # -- catalog
    def _list_dirs(self, path: str):
        if not self._exists(path):
            return []
        return [s for s in self._fs.listStatus(self._Path(path)) if s.isDirectory()]

    def _list_versions(self, path: str):
        """Versions are folders that Spark wrote and single files of a known format."""
        if not self._exists(path):
            return []
        return [s for s in self._fs.listStatus(self._Path(path))
                if s.isDirectory() or s.getPath().getName().rsplit(".", 1)[-1] in FORMATS]

    def catalog(self) -> DataFrame:
        rows = []
        for ds in self._list_dirs(self.base):
            dname = ds.getPath().getName()
            for v in self._list_versions(ds.getPath().toString()):
                vname = v.getPath().getName()
                fmt = vname.rsplit(".", 1)[-1] if "." in vname else "parquet"
                rows.append((dname, vname, v.getPath().toString(), fmt,
                             dt.datetime.utcfromtimestamp(v.getModificationTime() / 1000.0)))
        return self.spark.createDataFrame(
            rows, "dataset string, version string, path string, format string, modified_at timestamp_ntz")

    def list_datasets(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._list_dirs(self.base)
                      if s.getPath().getName() not in HIDDEN_DATASETS)

    def list_versions(self, dataset: str) -> list[str]:
        """Newest first: by version stamp, then by save within the stamp."""
        return sorted((s.getPath().getName() for s in self._list_versions(self._dataset_dir(dataset))),
                      key=version_key, reverse=True)

    def version_info(self, dataset: str, version: str) -> dict:
        c = self.catalog().where((F.col("dataset") == slugify_name(dataset)) & (F.col("version") == version)).collect()
        if not c:
            raise LakeError(f"no version {version} of {dataset}")
        return c[0].asDict()

    def resolve(self, dataset: str, version: str = "latest") -> tuple[str, str]:
        vs = self.list_versions(dataset)
        if not vs:
            raise LakeError(f"dataset {dataset} has no versions")
        v = vs[0] if version == "latest" else self._check(version)
        if v not in vs:
            raise LakeError(f"no version {version} of {dataset}")
        fmt = v.rsplit(".", 1)[-1] if "." in v else "parquet"
        if fmt not in FORMATS:
            raise LakeError(f"unsupported format {fmt}")
        return f"{self._dataset_dir(dataset)}/{v}", fmt

    # -- read (A01-A06)
    def load(self, dataset: str, version: str = "latest", limit: int | None = None, schema=None,
             names=None, **options) -> DataFrame:
        path, fmt = self.resolve(dataset, version)
        reader = lambda: self.spark.read if schema is None else self.spark.read.schema(schema)
        r = reader()
        if fmt == "csv":
            opts = {"header": True, "inferSchema": schema is None}
            opts.update(options)
            if "encoding" in opts:
                opts.update(self._encoding(opts["encoding"]))
            df = r.options(**opts).csv(path)
        elif fmt == "json":
            df = self._load_json(reader, path, options)
        elif fmt == "text":
            df = r.text(path).withColumnRenamed("value", "text")
        elif fmt == "zip":
            df = zip_members(self.spark, path)
        else:
            df = r.parquet(path)
        if names:
            df = df.toDF(*names)
        return df.limit(limit) if limit else df

    def _encoding(self, name: str) -> dict:
        """The reader options of an encoding.  A byte-order mark settles UTF-16 for a
        whole file, so such files are read unsplit."""
        found = CSV_ENCODINGS.get(name.lower())
        if found is None:
            raise LakeError(f"unsupported encoding {name}; known: {', '.join(CSV_ENCODINGS)}")
        if found == "windows-1252":
            # a charset of the Java platform beyond the ones that Spark lists itself
            self.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        return {"encoding": found} | ({"multiLine": True} if found == "UTF-16" else {})

    def _json_files(self, path: str) -> dict[str, list[str]]:
        """Files by kind: ``array`` (begins with ``[``), ``lines`` (some line is an object
        by itself) or ``object`` (one over many lines).  One row for each file comes to
        the driver, as its readers need their paths anyway."""
        line = F.trim("value")
        lines = (self.spark.read.text(path)
                 .select(line.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("nth"))
                 .where("line <> ''"))
        alone = F.col("line").startswith("{") & F.col("line").endswith("}")
        files = lines.groupBy("file").agg(F.min_by(F.substring("line", 1, 1), F.struct("start", "nth")).alias("first"),
                                          F.max(alone).alias("any_alone")).collect()
        kinds: dict[str, list[str]] = {"lines": [], "array": [], "object": []}
        for r in sorted(files, key=lambda r: r["file"]):
            kinds["array" if r["first"] == "[" else "lines" if r["any_alone"] else "object"].append(r["file"])
        return kinds

    def _load_json(self, reader, path: str, options: dict) -> DataFrame:
        """JSON lines, or a document that is an array, decided file by file.  A line
        (or an object over many lines) that does not parse is a row of nulls, or raises
        with ``mode="FAILFAST"``; an array that does not parse raises, for its rows cannot
        be told apart."""
        how = {"lines": {}, "object": {"multiLine": True}, "array": {"multiLine": True, "mode": "FAILFAST"}}
        kinds = self._json_files(path)
        # a fresh reader for each kind: options stay with a reader
        read = [reader().options(**{**options, **how[kind]}).json(files) for kind, files in kinds.items() if files]
        if not read:
            return reader().options(**options).json(path)
        df = read[0]
        for other in read[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        return df if "columnNameOfCorruptRecord" in options else df.drop("_corrupt_record")

    # -- delete
    def delete(self, dataset: str, version: str) -> bool:
        d = self._dataset_dir(dataset)
        p = f"{d}/{self._check(version)}"
        if not self._exists(p):
            raise LakeError(f"no version {version} of {dataset}")
        self._fs.delete(self._Path(p), True)
        if not self._list_dirs(d) and not list(self._fs.listStatus(self._Path(d))):
            self._fs.delete(self._Path(d), True)
        return True


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive member name, archives read as binary files
    and listed inside the executors.  An archive that cannot be read raises."""
    import io
    import zipfile

    import pandas as pd

    def members(batches):
        for b in batches:
            out_p, out_m = [], []
            for p, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for n in z.namelist():
                            out_p.append(p)
                            out_m.append(n)
                except zipfile.BadZipFile as e:
                    raise LakeError(f"not a zip archive: {p}") from e
            yield pd.DataFrame({"path": out_p, "archive_member": out_m})
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content").mapInPandas(members, "path string, archive_member string")


IMAGE_GLOB = "*.{png,jpg,jpeg,bmp,gif,tif,tiff}"


def image_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A17 (class folders): path -> class from the parent folder name; file
    contents are never read (only the path column is selected)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", IMAGE_GLOB).load(root).select("path"))
    return files.select("path", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("label"),
                        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"))


def label_manifest(images: DataFrame, labels: DataFrame, file_col: str = "filename") -> DataFrame:
    """A17 / E04 (label CSV): inner join of image files with a label table by file name."""
    return images.drop("label").join(labels, file_col, "inner")


def pair_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """A17 (segmentation): image / mask pairs by file stem (not by position)."""
    stem = F.regexp_replace(F.col("filename"), r"\.[^.]+$", "")
    a = images.select(stem.alias("stem"), F.col("path").alias("image_path"))
    b = masks.select(stem.alias("stem"), F.col("path").alias("mask_path"))
    return a.join(b, "stem", "inner")
