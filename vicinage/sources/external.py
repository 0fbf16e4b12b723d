"""External records: structure files, JSON records, job lists and earlier results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinage.functions.scalars import completeness, first_text
from vicinage.operators.universe import keep_first

STRUCTURE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("parse_status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("formula", T.StringType()),
        T.StructField("elements", T.ArrayType(T.StringType())),
        T.StructField("counts", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("n_sites", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("a_axis", "b_axis", "c_axis", "alpha", "beta", "gamma", "volume", "volume_per_atom", "c_over_a", "c_over_b", "max_axis_over_min_axis", "frac_z_span", "cart_z_span_over_c")],
        *[T.StructField(c, T.DoubleType()) for c in ("coord_mean", "coord_std", "coord_min", "coord_max", "frac_low_coord_sites", "frac_high_coord_sites")],
        *[T.StructField(c, T.DoubleType()) for c in ("bond_length_mean", "bond_length_std", "bond_length_range", "frac_short_bonds")],
    ]
)
DESCRIPTORS = [f.name for f in STRUCTURE.fields if isinstance(f.dataType, T.DoubleType)]


def structure_format(path: Column) -> Column:
    """poscar or cif from a file name; null for other names."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.endswith(".vasp") | F.contains(name, F.lit("poscar")) | F.contains(name, F.lit("contcar")), "poscar").when(name.endswith(".cif"), "cif")


def external_id(content: Column, day: Column, prefix: str = "EXT") -> Column:
    """Prefix, day and the first ten hex digits of the content's SHA-256."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.upper(F.substring(F.sha2(content, 256), 1, 10)))


def parse_poscar(text: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lattice, species of each site and fractional coordinates."""
    lines = [line.strip() for line in text.strip("\n").split("\n")]
    scale = float(lines[1].split()[0])
    lattice = np.array([[float(x) for x in lines[i].split()[:3]] for i in (2, 3, 4)])
    lattice = lattice * (scale if scale > 0 else (-scale / abs(np.linalg.det(lattice))) ** (1 / 3))
    symbols, numbers = lines[5].split(), [int(x) for x in lines[6].split()]
    if len(symbols) != len(numbers):
        raise ValueError("species and numbers differ in length")
    at = 8 if lines[7][:1].lower() == "s" else 7
    cartesian = lines[at][:1].lower() in ("c", "k")
    n = sum(numbers)
    sites = np.array([[float(x) for x in lines[at + 1 + i].split()[:3]] for i in range(n)])
    coords = sites * scale @ np.linalg.inv(lattice) if cartesian else sites
    return lattice, [s for s, k in zip(symbols, numbers) for _ in range(k)], coords


def geometry(lattice: np.ndarray, species: Sequence[str], coords: np.ndarray, *, cutoff: float = 3.0, bond: float = 4.0, low: int = 2, high: int = 8, short: float = 2.2) -> dict:
    """Axes, angles, spans, coordination within ``cutoff`` and bond lengths within ``bond``, over neighbouring cells."""
    axes = np.linalg.norm(lattice, axis=1)
    angle = lambda u, v: float(np.degrees(np.arccos(np.clip(u @ v / (np.linalg.norm(u) * np.linalg.norm(v)), -1, 1))))
    volume, n = float(abs(np.linalg.det(lattice))), len(species)
    # as many neighbouring cells as the longer radius reaches in each direction
    heights = volume / np.array([np.linalg.norm(np.cross(lattice[(i + 1) % 3], lattice[(i + 2) % 3])) for i in range(3)])
    reach = np.ceil(max(cutoff, bond) / heights).astype(int)
    shifts = np.array([(i, j, k) for i in range(-reach[0], reach[0] + 1) for j in range(-reach[1], reach[1] + 1) for k in range(-reach[2], reach[2] + 1)])
    frac = coords % 1.0
    numbers, lengths = np.zeros(n), []
    for i in range(n):
        gap = np.linalg.norm((frac[None] + shifts[:, None] - frac[i]) @ lattice, axis=2)
        numbers[i] = ((gap > 1e-8) & (gap <= cutoff)).sum()
        later = gap[:, i + 1 :]
        lengths.append(later[(later > 1e-8) & (later <= bond)])
    bonds = np.concatenate(lengths) if lengths else np.array([])
    z = frac[:, 2]
    out = {
        "n_sites": n, "a_axis": axes[0], "b_axis": axes[1], "c_axis": axes[2],
        "alpha": angle(lattice[1], lattice[2]), "beta": angle(lattice[0], lattice[2]), "gamma": angle(lattice[0], lattice[1]), "volume": volume, "volume_per_atom": volume / n,
        "c_over_a": axes[2] / axes[0], "c_over_b": axes[2] / axes[1], "max_axis_over_min_axis": axes.max() / axes.min(), "frac_z_span": float(z.max() - z.min()),
        "cart_z_span_over_c": float(np.ptp((frac @ lattice)[:, 2]) / axes[2]),
        "coord_mean": numbers.mean(), "coord_std": numbers.std(), "coord_min": numbers.min(), "coord_max": numbers.max(), "frac_low_coord_sites": float((numbers <= low).mean()), "frac_high_coord_sites": float((numbers >= high).mean()),
    }
    if len(bonds):
        out |= {"bond_length_mean": bonds.mean(), "bond_length_std": bonds.std(), "bond_length_range": float(np.ptp(bonds)), "frac_short_bonds": float((bonds < short).mean())}
    return out


def _describe(path: str, content: bytes | None, kind: str | None) -> dict:
    row: dict = {"path": path, "parse_status": "failed", "error": None}
    try:
        if kind != "poscar":
            raise ValueError(f"no reader for the format of {path}")
        lattice, species, coords = parse_poscar(bytes(content).decode("utf-8-sig"))
        counts = {s: species.count(s) for s in sorted(set(species))}
        row |= geometry(lattice, species, coords) | {"elements": sorted(counts), "counts": counts, "formula": "".join(s + (str(k) if k > 1 else "") for s, k in counts.items())}
        row["parse_status"] = "success"
    except Exception as e:  # noqa: BLE001
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def _describe_batches(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [_describe(p, c, k) for p, c, k in zip(frame["path"], frame["content"], frame["kind"])]
        # absent lists and maps stay None, which a table of floats would turn into NaN
        yield pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=float if f.name in DESCRIPTORS else object) for f in STRUCTURE.fields})


def ingest_structures(files: DataFrame) -> DataFrame:
    """Descriptors of structure files (``path``, ``content`` as read by ``binaryFile``).

    A file that can't be read gives a row with status ``failed`` and its error;
    no file stops the others. Symmetry is not derived.
    """
    return files.select("path", "content", structure_format(F.col("path")).alias("kind")).mapInPandas(_describe_batches, STRUCTURE)


def read_structures(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    described = ingest_structures(files)
    ids = files.select(F.col("path"), external_id(F.col("content"), F.current_date()).alias("external_id"))
    return described.join(ids, "path")


def validate(df: DataFrame, required: Sequence[str] = DESCRIPTORS, *, least: float = 0.75) -> DataFrame:
    """``df`` with ``completeness`` and ``validation_status`` of external records."""
    share = completeness(required)
    status = (
        F.when(F.col("parse_status") != "success", "rejected_parse_failure")
        .when(F.size("elements") == 0, "rejected_invalid_species")
        .when(~F.coalesce(F.col("volume") > 1e-6, F.lit(False)), "rejected_invalid_geometry")
        .when(share < least, "rejected_insufficient_descriptors")
        .when(share < 1.0, "accepted_with_warnings")
        .otherwise("accepted")
    )
    return df.withColumn("completeness", share).withColumn("validation_status", status)


def read_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """JSON records, one object a file; unreadable files give a row with ``_corrupt_record``."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(paths)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a CSV or text list: ``jid`` in upper case, first places kept, comments and blanks dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.monotonically_increasing_id().alias("at"))
    ids = lines.filter(~F.trim("line").startswith("#")).select(F.regexp_extract(F.upper("line"), r"(?:^|[,;\t ])\"?(JVASP-[0-9]+)", 1).alias("jid"), "at").filter("jid != ''")
    return ids.groupBy("jid").agg(F.min("at").alias("at")).orderBy("at").select("jid")


def discover_results(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    """Earlier JSON results below a folder: id, path and ``status``.

    Statuses: compatible, incompatible_schema, duplicate (a smaller path has the
    id) and unreadable.
    """
    # a document is text here: its parts are looked up by path, whatever its shape
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    at = lambda p: F.get_json_object("value", p)
    told = files.select("path", at("$.schema_version").alias("schema_version"), F.coalesce(at("$.query.jid"), at("$.query.external_id"), F.element_at(F.split("path", "/"), -2)).alias("id"), F.try_parse_json("value").isNull().alias("broken"))
    fine = told.filter(~F.col("broken") & (F.col("schema_version") == version))
    first = keep_first(fine, ["id"], [F.col("path")]).select("path", F.lit(True).alias("first"))
    status = F.when(F.col("broken"), "unreadable").when(~F.col("schema_version").eqNullSafe(version), "incompatible_schema").when(F.col("first"), "compatible").otherwise("duplicate")
    return told.join(first, "path", "left").select("id", "path", status.alias("status"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("pool_name",), *, mode: str = "overwrite") -> None:
    """Parquet, partitioned, one shuffle by the partition columns, so that each folder gets few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def write_matrix(long: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A square similarity table out of its long form; ``ids`` are the columns, at most 1,000."""
    if len(ids) > 1_000:
        raise ValueError("a full matrix is limited to 1,000 entities")
    return long.groupBy("id").pivot("other", list(ids)).agg(F.first("similarity"))


def first_id(df: DataFrame) -> Column:
    return first_text(df, ["jid", "external_id", "material_id", "id"])
