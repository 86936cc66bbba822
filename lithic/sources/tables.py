"""Readers and writers of point tables, containers and meshes."""

from __future__ import annotations

import json
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.core import nan_to_null
from lithic.operators.blocks import BlockSet
from lithic.operators.lattice import Grid


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", missing: str | None = None, header: bool = True, encoding: str = "UTF-8", percent: list[str] = ()) -> DataFrame:
    """A text table with an explicit schema; `missing` marks nulls, `percent` columns become shares. A leading byte-order mark is dropped."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue=missing, encoding=encoding, enforceSchema=True)
    if missing is not None:
        floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
        try:
            value = float(missing)
            df = df.withColumns({c: F.when(F.col(c) != value, F.col(c)) for c in floats})
        except ValueError:
            pass
    return nan_to_null(df.withColumns({c: F.col(c) / 100 for c in percent}))


#: Layouts of sample tables in public circulation: column types, separator, missing value, percentages (fixed values).
LAYOUTS = {
    "walker": {"schema": "ID long, X double, Y double, V double, U double, T double", "sep": "\t", "missing": "-999"},
    "jura": {"schema": "Xloc double, Yloc double, long double, lat double, Landuse string, Rock string, Cd double, Co double, Cr double, Cu double, Ni double, Pb double, Zn double"},
    "arctic_lake": {"schema": "Sand double, Silt double, Clay double, Depth double", "percent": ["Sand", "Silt", "Clay"]},
    "planes": {"schema": "X double, Y double, Z double, dip double, azimuth double, strike double, type string"},
    "collar": {"schema": "hole string, x double, y double, z double, length double, dip double, azimuth double"},
    "survey": {"schema": "hole string, depth double, dip double, azimuth double"},
}


def read_sample(spark: SparkSession, kind: str, path: str, **changes) -> DataFrame:
    if kind not in LAYOUTS:
        raise ValueError(f"known layouts are {sorted(LAYOUTS)}")
    return read_delimited(spark, path, **(LAYOUTS[kind] | changes))


#: Faces in one file of drawing entities: some megabytes of text.
FILE_FACES = 20_000

KINDS = {"grid": Grid, "blockset": BlockSet}


def write_container(df: DataFrame, path: str, geometry: Grid | BlockSet | None = None, attributes: dict | None = None) -> None:
    """Rows as Parquet and, beside them, one JSON row with the kind of container and its geometry.

    A lattice's coordinates are not written: they follow from its parameters. Both parts go through
    Spark's own writers, so any file system that Spark reaches will do.
    """
    kind = next((k for k, c in KINDS.items() if isinstance(geometry, c)), "points")
    if kind == "grid":
        df = df.drop(*geometry.labels)
    df.write.mode("overwrite").parquet(f"{path}/rows")
    note = json.dumps({"kind": kind, "geometry": asdict(geometry) if geometry else None, "attributes": attributes or {}})
    df.sparkSession.range(1).select(F.lit(note).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/note")


def open_container(spark: SparkSession, path: str) -> tuple[DataFrame, Grid | BlockSet | None, dict]:
    """Rows, geometry and attributes; rows of a lattice get their coordinates back from it."""
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    df = spark.read.parquet(f"{path}/rows")
    if note["kind"] == "points":
        return df, None, note["attributes"]
    parameters = {k: tuple(map(tuple, v)) if k == "rotation" and v else tuple(v) if isinstance(v, list) else v for k, v in note["geometry"].items()}
    geometry = KINDS[note["kind"]](**parameters)
    if note["kind"] == "grid":
        df = geometry.rows(spark).join(df, "cell", "left")
    return df, geometry, note["attributes"]


def export_mesh_csv(vertex: DataFrame, face: DataFrame, points_path: str, faces_path: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """Points and triangles as two text tables, coordinates moved by `offset`."""
    vertex.select("v", *((F.col(c) + o).alias(c) for c, o in zip("xyz", offset))).write.mode("overwrite").csv(points_path, header=True)
    face.select("f", "a", "b", "c").write.mode("overwrite").csv(faces_path, header=True)


def write_dxf(vertex: DataFrame, face: DataFrame, path: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """Faces as 3DFACE entities of an ASCII file; each face is one row of text, so files of any size are written in parallel parts in face order, each of at most `FILE_FACES` faces."""
    from lithic.operators.mesh import corners

    full = corners(vertex, face)
    codes = []
    for i, k in enumerate("abcc"):
        for j, (c, o) in enumerate(zip("xyz", offset)):
            codes += [F.lit(f"{10 * (j + 1) + i}"), (F.col(f"{k}{c}") + o).cast("string")]
    body = full.select(F.col("f").alias("__k"), F.concat_ws("\n", F.lit("0\n3DFACE\n8\nmesh"), *codes).alias("value"))
    spark = vertex.sparkSession
    head = spark.range(1).select(F.lit(None).cast("long").alias("__k"), F.lit("0\nSECTION\n2\nENTITIES").alias("value"))
    tail = spark.range(1).select(F.lit((1 << 63) - 1).cast("long").alias("__k"), F.lit("0\nENDSEC\n0\nEOF").alias("value"))
    head.unionByName(body).unionByName(tail).orderBy(F.col("__k").asc_nulls_first()).select("value").write.mode("overwrite").option("maxRecordsPerFile", FILE_FACES).text(path)


def read_dxf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """3DFACE entities of ASCII files as welded vertices and faces; degenerate faces are dropped.

    An entity lies on consecutive lines, so each file is read in one piece, files in parallel. Texts are cut
    before entities where they are read; Python sees entities one by one and never a whole file.
    """
    from lithic.operators.mesh import drop_degenerate, weld

    def corners_of(text: str) -> list[list[float]] | None:
        lines, entity = [x.strip() for x in text.splitlines()], {}
        for code, value in zip(lines[::2], lines[1::2]):
            if code == "0":
                break
            if code.isdigit() and 10 <= int(code) <= 33:
                entity[int(code)] = float(value)
        return [[entity.get(10 * (j + 1) + i, 0.0) for j in range(3)] for i in range(4)] if entity else None

    def parse(batches):
        for b in batches:
            rows = [c for text in b.column("value") if (c := corners_of(text.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.list_(pa.float64())))], ["corners"])

    start = r"(?<=[\r\n])[ \t]*0[ \t]*(?:\r\n|\r|\n)[ \t]*3DFACE[ \t]*(?:\r\n|\r|\n)"
    texts = spark.read.text(path, wholetext=True).select(F.split(F.concat(F.lit("\n"), "value"), start).alias("t"))
    entities = texts.select(F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("value"))
    raw = entities.mapInArrow(parse, "corners array<array<double>>")
    quads = raw.withColumn("q", F.monotonically_increasing_id())
    last = F.when(F.size(F.array_distinct(F.slice("corners", 3, 2))) < 2, F.array(F.array(F.lit(0), F.lit(1), F.lit(2)))).otherwise(F.array(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(2), F.lit(3))))
    tri = quads.select("q", "corners", F.posexplode(last).alias("i", "t")).select((F.col("q") * 2 + F.col("i")).alias("f"), *(F.element_at("corners", F.col("t")[j] + 1).alias(k) for j, k in enumerate("abc")))
    vertex = tri.select(F.explode(F.array(*(F.struct((F.col("f") * 3 + j).alias("v"), F.col(k).alias("p")) for j, k in enumerate("abc")))).alias("s")).select("s.v", *(F.col("s.p")[j].alias(c) for j, c in enumerate("xyz")))
    face = tri.select("f", *((F.col("f") * 3 + j).alias(k) for j, k in enumerate("abc")))
    vertex, face = weld(vertex, face)
    return vertex, drop_degenerate(vertex, face)
