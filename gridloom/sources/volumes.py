"""Volume and report files as tables, and the sinks for them.

Files come through Spark's `binaryFile` source, so any store that Spark reads will do; headers and
arrays are parsed in mapInPandas. Long tables have one row a voxel, geometry one row a file.
"""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shipped

#: MetaImage element types.
MET = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
GEOMETRY = "path string, nx long, ny long, nz long, sx double, sy double, sz double, origin array<double>, direction array<double>"


def list_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of matching files; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")


def first_input(spark: SparkSession, folder: str) -> str:
    """The first .mha or .mhd file in order of path; fails if there is none."""
    found = list_files(spark, folder, "*.{mha,mhd}").orderBy("path").limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no input image in {folder}")
    return found[0]["path"]


def cases(files: DataFrame, image: str = "image", label: str = "label") -> DataFrame:
    """(part, case_id) of folders <part>/<case>/ that hold both an image and a label."""
    parts = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1).alias("part"), F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2).alias("case_id"), F.regexp_extract("path", r"/([^/.]+)[^/]*$", 1).alias("kind"))
    return parts.where(F.col("kind").isin(image, label)).groupBy("part", "case_id").agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2").drop("kinds")


def subset(all_cases: DataFrame, wanted: list[str], key: str = "case_id") -> DataFrame:
    """The wanted cases; ids are padded to three digits, and unknown ones fail by name."""
    ids = all_cases.sparkSession.createDataFrame([(w.zfill(3),) for w in wanted], f"{key} string")
    missing = sorted(r[0] for r in ids.join(all_cases, key, "left_anti").collect())
    if missing:
        raise ValueError(f"unknown cases: {', '.join(missing)}")
    return all_cases.join(F.broadcast(ids), key, "left_semi")  # a list given by hand


def parse_mha(content: bytes) -> tuple[dict, np.ndarray]:
    """Header and array (z, y, x) of a MetaImage with its data inside."""
    header, at = {}, 0
    while True:
        end = content.index(b"\n", at)
        key, _, value = content[at:end].decode("latin-1").partition("=")
        header[key.strip()] = value.strip()
        at = end + 1
        if key.strip() == "ElementDataFile":
            break
    if header["ElementDataFile"] != "LOCAL":
        raise ValueError("the data must stand in the file")
    data = zlib.decompress(content[at:]) if header.get("CompressedData", "False") == "True" else content[at:]
    order = ">" if header.get("BinaryDataByteOrderMSB", "False") == "True" else "<"
    nx, ny, nz = (int(v) for v in header["DimSize"].split())
    return header, np.frombuffer(data, order + MET[header["ElementType"]], nx * ny * nz).reshape(nz, ny, nx)


def _geometry(path: str, header: dict) -> dict:
    n = [int(v) for v in header["DimSize"].split()]
    s = [float(v) for v in header.get("ElementSpacing", header.get("ElementSize", "1 1 1")).split()]
    return {"path": path, "nx": n[0], "ny": n[1], "nz": n[2], "sx": s[0], "sy": s[1], "sz": s[2], "origin": [float(v) for v in header.get("Offset", "0 0 0").split()], "direction": [float(v) for v in header.get("TransformMatrix", "1 0 0 0 1 0 0 0 1").split()]}


def read_mha(spark: SparkSession, folder: str, pattern: str = "*.mha") -> tuple[DataFrame, DataFrame]:
    """(voxels, geometry): (path, z, y, x, value) and one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def voxels(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a = parse_mha(content)[1]
                for z in range(a.shape[0]):  # a plane at a time
                    y, x = np.indices(a.shape[1:])
                    yield pd.DataFrame({"path": path, "z": z, "y": y.ravel(), "x": x.ravel(), "value": a[z].ravel().astype(float)})

    def geometry(batches):
        for pdf in batches:
            yield pd.DataFrame([_geometry(p, parse_mha(c)[0]) for p, c in zip(pdf["path"], pdf["content"])])

    return files.mapInPandas(shipped(files, voxels), "path string, z long, y long, x long, value double"), files.mapInPandas(shipped(files, geometry), GEOMETRY)


def mha_bytes(a: np.ndarray, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), direction=(1, 0, 0, 0, 1, 0, 0, 0, 1), compressed: bool = False) -> bytes:
    kind = next(k for k, v in MET.items() if np.dtype(v) == a.dtype)
    body = a.astype(a.dtype.newbyteorder("<")).tobytes()
    body = zlib.compress(body) if compressed else body
    say = lambda v: " ".join(f"{x:g}" for x in v)
    head = ["ObjectType = Image", "NDims = 3", "BinaryData = True", "BinaryDataByteOrderMSB = False", f"CompressedData = {compressed}"] + ([f"CompressedDataSize = {len(body)}"] if compressed else []) + [f"TransformMatrix = {say(direction)}", f"Offset = {say(origin)}", f"ElementSpacing = {say(spacing)}", f"DimSize = {a.shape[2]} {a.shape[1]} {a.shape[0]}", f"ElementType = {kind}", "ElementDataFile = LOCAL"]
    return ("\n".join(head) + "\n").encode() + body


def label_values(v) -> F.Column:
    """Ids as they are written: clipped to 0..200."""
    return F.greatest(F.least(v, F.lit(200)), F.lit(0)).cast("short")


def crop(grid: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """The part in the half-open box, from 0; fails on an empty box."""
    if any(b <= a for a, b in box.values()):
        raise ValueError(f"empty box: {box}")
    out = grid
    for axis, (a, b) in box.items():
        out = out.where((F.col(axis) >= a) & (F.col(axis) < b)).withColumn(axis, F.col(axis) - a)
    return out


def cropped_origin(origin: list[F.Column], direction: list[F.Column], spacing: list[F.Column], start: list[F.Column]) -> list[F.Column]:
    """origin + direction x (start times spacing), all in x, y, z."""
    return [origin[r] + sum(direction[3 * r + c] * start[c] * spacing[c] for c in range(3)) for r in range(3)]


def read_npz(spark: SparkSession, folder: str, keys=("probabilities", "softmax"), pattern: str = "*.{npz,npy}") -> DataFrame:
    """(path, c, z, y, x, value) of the first preferred array of each file, or its first one; it must have four axes. A .npy file is one array."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def rows(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(a, np.ndarray):
                    a = a[next((k for k in keys if k in a.files), a.files[0])]
                if a.ndim != 4:
                    raise ValueError(f"{path}: four axes are needed, not {a.ndim}")
                for c in range(a.shape[0]):  # a plane at a time
                    for z in range(a.shape[1]):
                        y, x = np.indices(a.shape[2:])
                        yield pd.DataFrame({"path": path, "c": c, "z": z, "y": y.ravel(), "x": x.ravel(), "value": a[c, z].ravel().astype(float)})

    return files.mapInPandas(shipped(files, rows), "path string, c long, z long, y long, x long, value double")


def read_evals(spark: SparkSession, folder: str, required=("dataset", "iou_f", "samples")) -> DataFrame:
    """(path, payload, iou_f) of JSON reports that parse and have the required keys, archives left out, by falling score."""
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    parsed = text.where(~F.regexp_extract("path", r"/(archive_[^/]*)/", 1).startswith("archive_")).withColumn("v", F.try_parse_json("payload")).where("v IS NOT NULL")
    for k in required:
        parsed = parsed.where(F.expr(f"get_json_object(payload, '$.{k}') IS NOT NULL"))
    return parsed.select("path", "payload", F.get_json_object("payload", "$.iou_f").cast("double").alias("iou_f")).orderBy(F.coalesce("iou_f", F.lit(-1.0)).desc(), "path")


def weight_files(files: DataFrame) -> DataFrame:
    """(path, dataset, run, fold, kind, mb, modified) of checkpoint files by their paths."""
    get = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit(""))
    return files.select("path", get(r"Dataset(\d+)").cast("long").alias("dataset"), get(r"/([^/]+)/fold_").alias("run"), get(r"/fold_(\w+)/").alias("fold"), get(r"checkpoint_(\w+)\.").alias("kind"), F.bround(F.col("length") / 1048576.0, 2).alias("mb"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(k, n, value): ordered lines of a mesh: vertices (n, x, y, z), then faces (n, a, b, c) counted from 1."""
    v = vertices.select(F.lit(0).alias("k"), "n", F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("value"))
    return v.unionByName(faces.select(F.lit(1).alias("k"), "n", F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value")))


def json_safe(value) -> str:
    """Nested values with paths, numpy scalars and arrays, NaN as null."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple, set)):
            return [plain(x) for x in v]
        if isinstance(v, np.ndarray):
            return plain(v.tolist())
        if isinstance(v, np.generic):
            return plain(v.item())
        if isinstance(v, float) and v != v:
            return None
        return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)

    return json.dumps(plain(value))
