"""The cost formulas, each written once, as columns over filled attributes."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.params import DEFAULT, KINDS, PROCESSES, RESIDUE_PRICES, CostParams

COST_COLUMNS = tuple(f"{p}_{k}" for p in PROCESSES for k in KINDS)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def replication_opportunity(gene_length, p: CostParams = DEFAULT) -> Column:
    return F.lit(p.strands) * _col(gene_length) * F.lit(p.replication_opportunity)


def replication_direct(gene_length, p: CostParams = DEFAULT) -> Column:
    return F.lit(p.strands) * _col(gene_length) * F.lit(p.replication_direct)


def protein_copies(abundance, p: CostParams = DEFAULT) -> Column:
    return _col(abundance) * F.lit(p.proteins_per_cell) / F.lit(p.ppm)


def mrna_copies(abundance, p: CostParams = DEFAULT) -> Column:
    return _col(abundance) / F.lit(p.proteins_per_mrna) * F.lit(p.proteins_per_cell) / F.lit(p.ppm)


def transcription_opportunity(abundance, gene_length, p: CostParams = DEFAULT) -> Column:
    made = mrna_copies(abundance, p)
    if p.opportunity_uses_length:
        made = made * _col(gene_length)
    return made * F.lit(p.transcription_opportunity)


def transcription_direct(abundance, gene_length, hours=1.0, p: CostParams = DEFAULT) -> Column:
    """Polymerisation once, and again for each turnover in ``hours``."""
    rounds = F.lit(p.repolymerisation * p.turnover_per_hour) * (
        hours if isinstance(hours, Column) else F.lit(float(hours))
    )
    return mrna_copies(abundance, p) * _col(gene_length) * (F.lit(p.polymerisation) + rounds)


def translation_opportunity(abundance, seq_opportunity, p: CostParams = DEFAULT) -> Column:
    return protein_copies(abundance, p) * _col(seq_opportunity)


def translation_direct(abundance, seq_direct, p: CostParams = DEFAULT) -> Column:
    return protein_copies(abundance, p) * _col(seq_direct)


def translation_by_length(abundance, protein_length, kind: str, p: CostParams = DEFAULT) -> Column:
    """Older form: a price per residue instead of the sequence's own price."""
    price = p.residue_opportunity if kind == "opportunity" else p.residue_direct
    return protein_copies(abundance, p) * _col(protein_length) * F.lit(price)


def ascii_upper(text: Column) -> Column:
    """Capital letters for a-z alone; other letters stay, so none of them turns into a priced one."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def price_sequences(df: DataFrame, text: str) -> DataFrame:
    """Adds ``seq_opportunity`` and ``seq_direct`` for a column of short texts such as names.

    The letters of the whole text are counted in the row that holds it, each once, and both prices read the counts:
    no explode, no join, no shuffle. Letters without a price are free.
    """
    counts = ", ".join(
        f"octet_length(__upper) - octet_length(replace(__upper, '{row[0]}', ''))" for row in RESIDUE_PRICES
    )

    def priced(place: int) -> Column:
        terms = [f"__letters[{i}] * {row[place]}" for i, row in enumerate(RESIDUE_PRICES)]
        return F.expr(f"cast({' + '.join(terms)} as double)")

    counted = df.withColumn("__upper", ascii_upper(F.col(text))).withColumn("__letters", F.expr(f"array({counts})"))
    kept = [c for c in df.columns if c not in ("seq_opportunity", "seq_direct")]
    return counted.select(*kept, priced(1).alias("seq_opportunity"), priced(2).alias("seq_direct"))


def price_texts(df: DataFrame, text: str) -> DataFrame:
    """The same for long texts: one look at every byte instead of one pass per letter.

    Arrow hands over whole columns of text; a table of 256 prices is applied to their bytes and summed per text. Bytes
    of letters beyond ASCII have no price.
    """
    priced = df.withColumn("__p", _byte_prices()(F.col(text)))
    return priced.withColumns({f"seq_{kind}": F.col(f"__p.{kind}") for kind in KINDS}).drop("__p")


def _byte_prices():
    prices = np.zeros((2, 256), dtype=np.uint8)
    for symbol, opportunity, direct in RESIDUE_PRICES:
        for byte in (ord(symbol), ord(symbol.lower())):
            prices[:, byte] = (opportunity, direct)
    kinds = list(KINDS)

    @F.arrow_udf("opportunity double, direct double")
    def byte_prices(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        filled = offsets[:-1] < offsets[1:]
        missing = np.asarray(texts.is_null())
        out = []
        for table in prices:
            sums = np.zeros(len(texts), dtype=np.int64)
            if filled.any():
                data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[: offsets[-1]]
                sums[filled] = np.add.reduceat(table[data], offsets[:-1][filled], dtype=np.int64)
            out.append(pa.array(sums.astype(np.float64), mask=missing))
        return pa.StructArray.from_arrays(out, kinds)

    return byte_prices


def cost_columns(
    p: CostParams = DEFAULT, hours=1.0, suffix: str = "_filled", method: str = "sequence"
) -> dict[str, Column]:
    """The six costs of a row: three processes, each as opportunity and direct."""
    ab, gl = F.col("abundance" + suffix), F.col("gene_length" + suffix)
    if method == "sequence":
        translation = {
            "translation_opportunity": translation_opportunity(ab, F.col("seq_opportunity" + suffix), p),
            "translation_direct": translation_direct(ab, F.col("seq_direct" + suffix), p),
        }
    elif method == "length":
        pl = F.col("protein_length" + suffix)
        translation = {f"translation_{k}": translation_by_length(ab, pl, k, p) for k in KINDS}
    else:
        raise ValueError(method)
    return {
        "replication_opportunity": replication_opportunity(gl, p),
        "replication_direct": replication_direct(gl, p),
        "transcription_opportunity": transcription_opportunity(ab, gl, p),
        "transcription_direct": transcription_direct(ab, gl, hours, p),
        **translation,
    }


def with_costs(df: DataFrame, p: CostParams = DEFAULT, hours=1.0, once: str | None = None, **options) -> DataFrame:
    """Adds the six cost columns.

    ``once`` names a flag column: all costs but direct transcription count only on flagged rows, the first
    appearance of an entity, because a gene is copied and its proteins are built once while transcripts are remade.
    """
    costs = cost_columns(p, hours, **options)
    if once is not None:
        costs = {
            name: c if name == "transcription_direct" else F.when(F.col(once), c).otherwise(F.lit(0.0))
            for name, c in costs.items()
        }
    return df.withColumns(costs)


def sum_costs(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The six costs summed per key: one narrow aggregate instead of six rows per input row."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in COST_COLUMNS])


def cost_long(
    wide: DataFrame, keys: Sequence[str], by: Sequence[str] = ("process", "kind"), value: str = "cost"
) -> DataFrame:
    """Cost rows (keys, process, kind, cost) of rows that hold the six costs; ``by`` picks the labels to keep.

    Labels come from the measure's own name. Measures that share the kept labels are added within the row, so nothing
    is regrouped.
    """
    rows: dict[tuple, list[str]] = {}
    for process in PROCESSES:
        for kind in KINDS:
            label = tuple(x for x, name in ((process, "process"), (kind, "kind")) if name in by)
            rows.setdefault(label, []).append(f"{process}_{kind}")
    cells = ", ".join(", ".join([*(f"'{x}'" for x in label), " + ".join(names)]) for label, names in rows.items())
    names = ", ".join([*(n for n in ("process", "kind") if n in by), value])
    return wide.select(*keys, F.expr(f"stack({len(rows)}, {cells}) AS ({names})"))


def total_cost() -> Column:
    return sum((F.col(c) for c in COST_COLUMNS[1:]), F.col(COST_COLUMNS[0]))


def genome_costs(p: CostParams = DEFAULT, unwinding: bool = True) -> dict[str, float]:
    """Copying the whole genome once."""
    direct = p.strands * p.genome_bases * p.replication_direct
    if unwinding:
        direct += p.genome_bases * p.unwinding_per_base
    return {"opportunity": p.strands * p.genome_bases * p.replication_opportunity, "direct": direct}


def lipid_molecules(length, width, p: CostParams = DEFAULT) -> Column:
    """Lipids of both leaflets of a rod, less the share taken by protein."""
    outer = F.lit(4 * math.pi) * _col(length) * _col(width) / F.lit(p.head_group_area)
    inner = F.lit(4 * math.pi) * ((_col(length) - p.bilayer) * (_col(width) - p.bilayer)) / F.lit(p.head_group_area)
    return (outer + inner) / F.lit(p.protein_discount)


def septum_lipids(width, p: CostParams = DEFAULT) -> Column:
    outer = F.lit(4.0) * _col(width) / F.lit(p.head_group_area) / F.lit(p.protein_discount)
    inner = F.lit(4.0) * (_col(width) - p.bilayer) / F.lit(p.head_group_area) / F.lit(p.protein_discount)
    return outer + inner


def sphere_lipids(radius, thickness: float = 3.5, discount: float = 2.0) -> Column:
    """Older endospore form: both leaflets of a sphere, one lipid per square nm, less the share taken by protein."""
    outer = F.lit(4 * math.pi) * _col(radius) * _col(radius)
    inner = F.lit(4 * math.pi) * (_col(radius) - thickness) * (_col(radius) - thickness)
    return (outer + inner) / F.lit(discount)


def lipid_cost(molecules: Column, kind: str, p: CostParams = DEFAULT) -> Column:
    return molecules * F.lit(p.lipid_opportunity if kind == "opportunity" else p.lipid_direct)


def septum_constants(p: CostParams = DEFAULT) -> dict[str, float]:
    """Septum cost of the default cell, as plain numbers."""
    lipids = (4 * p.cell_width + 4 * (p.cell_width - p.bilayer)) / p.head_group_area / p.protein_discount
    return {"opportunity": lipids * p.lipid_opportunity, "direct": lipids * p.lipid_direct}


def membrane_constants(p: CostParams = DEFAULT) -> dict[str, float]:
    """Membrane cost of the default cell, as plain numbers."""
    a, b, h = p.cell_length, p.cell_width, p.bilayer
    lipids = (4 * math.pi * a * b + 4 * math.pi * (a - h) * (b - h)) / p.head_group_area / p.protein_discount
    return {"opportunity": lipids * p.lipid_opportunity, "direct": lipids * p.lipid_direct}
