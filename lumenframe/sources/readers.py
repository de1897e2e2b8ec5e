"""Scans: Parquet, CSV, matrix market, feature and barcode lists, sample sheets, JSON, and configuration. Schemas are declared, never inferred."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "cell_id string, x_centroid double, y_centroid double, transcript_counts long, control_probe_counts long, control_codeword_counts long, genomic_control_counts long, total_counts long, cell_area double, nucleus_count long, nucleus_area double"
BOUNDARIES = "cell_id string, vertex_x double, vertex_y double"
SAMPLES = "sample_id string, xenium_dir string, registered_he_ome_tif string, boundary_source string, notes string"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, separator: str = ",", parts: int | None = None) -> DataFrame:
    """A table with a header. A gzip file is one task however large; ``parts`` deals its rows out before any work."""
    df = spark.read.schema(schema).option("header", True).option("sep", separator).csv(path)
    return df.repartition(parts) if parts else df


def samples(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    df = csv(spark, path, SAMPLES, "\t")
    return df.where(F.col("sample_id").isin(ids)) if ids is not None else df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of one small text file in order, from 0; such a file is a dictionary."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(gene_idx, gene) of a list of names, one a line; blanks are dropped."""
    lines = numbered_lines(spark, path).select("line", F.trim("value").alias("gene")).where("length(gene) > 0")
    return lines.select((F.row_number().over(Window.orderBy("line")) - 1).cast("int").alias("gene_idx"), "gene")


def features(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(gene_idx, gene_id, gene, kind) of an id/name/kind list; an empty name falls back to the id, repeats get a number."""
    from ..functions.scalar import unique_names

    rows = numbered_lines(spark, path).where("length(value) > 0").withColumn("f", F.split("value", "\t"))
    part = lambda i: F.get("f", F.lit(i))
    rows = rows.select(F.col("line").alias("gene_idx"), part(0).alias("gene_id"), F.coalesce(F.nullif(part(1), F.lit("")), part(0)).alias("name"), part(2).alias("kind"))
    rows = rows.withColumn("gene", unique_names("name", "gene_idx")).drop("name")
    return rows.where(F.col("kind") == kind) if kind else rows


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(cell_idx, cell_id): the first field of each line."""
    rows = numbered_lines(spark, path).where("length(value) > 0")
    return rows.select(F.col("line").alias("cell_idx"), F.split("value", "\t")[0].alias("cell_id"))


def matrix_market(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(gene_idx, cell_idx, n) of a features-by-cells coordinate file, from 0. Comments and the line of sizes are told by their form:
    the sizes are the one triple before which no data line stands, read first to be taken out by value and place."""
    text = spark.read.text(path).where(~F.col("value").startswith("%"))
    sizes = text.first()
    if sizes is None:
        raise ValueError(f"{path} holds no matrix")
    rows, cols, entries = (int(x) for x in sizes[0].split())
    fields = F.split(F.trim("value"), r"\s+")
    triples = (text.repartition(parts) if parts else text).select((fields[0].cast("long") - 1).alias("gene_idx"), (fields[1].cast("long") - 1).alias("cell_idx"), fields[2].cast("double").alias("n"), "value")
    out = triples.where(F.col("value") != sizes[0]).drop("value")
    same = triples.where(F.col("value") == sizes[0]).count() - 1  # entries that look like the line of sizes
    if same > 0:
        extra = spark.range(same).select(F.lit(rows - 1).cast("long").alias("gene_idx"), F.lit(cols - 1).cast("long").alias("cell_idx"), F.lit(float(entries)).alias("n"))
        out = out.unionAll(extra)
    return out


def checked_matrix(matrix: DataFrame, n_genes: int, n_cells: int) -> DataFrame:
    row = matrix.agg(F.min("gene_idx"), F.max("gene_idx"), F.min("cell_idx"), F.max("cell_idx")).first()
    if row[0] is not None and (row[0] < 0 or row[1] >= n_genes or row[2] < 0 or row[3] >= n_cells):
        raise ValueError("the matrix has entries beyond its feature and barcode lists")
    return matrix


def json_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of binary files; contents are read only where they are used."""
    return spark.read.format("binaryFile").load(path)


def image_resolution(numerator: int, denominator: int) -> float:
    """Micrometres per pixel from a resolution tag in pixels per centimetre."""
    return 10000.0 / (numerator / denominator)


#: Micrometres in the length units of OME metadata.
UNITS = {"µm": 1.0, "um": 1.0, "nm": 1e-3, "mm": 1e3, "cm": 1e4, "m": 1e6}


def ome_pixel_size(df: DataFrame, xml: str = "xml") -> DataFrame:
    """um_per_px and channels from a column of OME XML (without namespaces); 1.0 where it says nothing."""
    size = F.expr(f"xpath_string({xml}, '//Pixels/@PhysicalSizeX')").try_cast("double")
    unit = F.expr(f"xpath_string({xml}, '//Pixels/@PhysicalSizeXUnit')")
    factor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.nullif(unit, F.lit(""))), F.lit(1.0))
    return df.withColumns({"um_per_px": F.coalesce(size * factor, F.lit(1.0)), "channels": F.expr(f"xpath({xml}, '//Channel/@Name')")})


def sample_specs(specs: list[str]) -> list[tuple[str, str, str]]:
    """ID|DIR|IMAGE triples."""
    out = [tuple(s.split("|")) for s in specs]
    if bad := [s for s, t in zip(specs, out, strict=True) if len(t) != 3]:
        raise ValueError(f"not ID|DIR|IMAGE: {bad}")
    return out


def int_list(text: str) -> list[int]:
    return sorted({int(x) for x in text.split(",") if x.strip()})


def float_list(text: str) -> list[float]:
    return sorted({float(x) for x in text.split(",") if x.strip()})


def resolved(base: str, path: str) -> str:
    """A path of a settings file: as it is if it is absolute or has a scheme, else below the folder ``base``."""
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"


@dataclasses.dataclass(frozen=True)
class Settings:
    """Parameters of a run, one seed for everything; a key that nothing reads is an error."""

    seed: int = 42
    neighbours: int = 30
    multi_neighbours: int = 60
    bandwidth: int = 15
    target_clusters: int = 30
    image_target_clusters: int = 40
    sample_effect_threshold: float = 0.10
    min_transcripts: int = 20
    components: int = 128
    run_harmony: bool = True
    patch_size: int = 224
    upsample: int = 4

    @classmethod
    def of(cls, values: dict) -> Settings:
        if unknown := sorted(set(values) - {f.name for f in dataclasses.fields(cls)}):
            raise ValueError(f"unknown settings {unknown}")
        return cls(**values)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Settings:
        """From a JSON document; a nested one may group keys, its groups' names don't count."""
        flat: dict = {}
        for name, value in json_document(spark, path).items():
            flat |= value if isinstance(value, dict) else {name: value}
        return cls.of(flat)


@dataclasses.dataclass(frozen=True)
class StagePaths:
    """Where a run's stages write, below one root."""

    root: str

    def of(self, stage: str, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), stage, *parts])


def dispatch(step: str, steps: dict, *arguments):
    """Runs the step of that name, or all in order for "all"; an unknown name is an error that lists the known ones."""
    if step == "all":
        return {name: run(*arguments) for name, run in steps.items()}
    if step not in steps:
        raise ValueError(f"unknown step {step!r}; there are {', '.join(['all', *steps])}")
    return steps[step](*arguments)
