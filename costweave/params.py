"""Cost constants. One frozen dataclass, with named variants."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CostParams:
    """Constants of the cost model, in ATP molecules unless a name says otherwise.

    Fixed values; results depend on them, so they are stated as plain numbers.
    """

    # protein pool
    proteins_per_cell: float = 1774445.0
    ppm: float = 1e6
    proteins_per_mrna: float = 100.0

    # fills for missing attributes
    fill_abundance: float = 18.0
    fill_gene_length: float = 765.0
    fill_protein_length: float = 254.0
    fill_seq_opportunity: float = 5723.0
    fill_seq_direct: float = 1351.0

    # replication, per base of both strands
    strands: float = 2.0
    replication_opportunity: float = 35.0
    replication_direct: float = 14.0

    # transcription, per base of mRNA
    transcription_opportunity: float = 31.0
    polymerisation: float = 10.0
    repolymerisation: float = 2.0
    turnover_per_hour: float = 12.0

    # translation by length, per residue
    residue_opportunity: float = 24.0
    residue_direct: float = 6.0

    # whole genome
    genome_bases: float = 4214810.0
    unwinding_per_base: float = 1.0

    # membrane geometry in nm, lipid prices per molecule
    head_group_area: float = 0.65
    bilayer: float = 4.0
    cell_length: float = 2500.0
    cell_width: float = 1000.0
    protein_discount: float = 2.0
    lipid_opportunity: float = 212.0
    lipid_direct: float = 18.0
    endospore_fraction: float = 6.0

    # budgets and selection
    cell_budget: float = 2.6e10
    basal_per_hour: float = 3.5e8
    selection_factor: float = 0.69

    # older germination accounting leaves the length out of transcription opportunity
    opportunity_uses_length: bool = True

    def but(self, **changes) -> "CostParams":
        return replace(self, **changes)


DEFAULT = CostParams()

# Sequence-cost medians of the germination gene set.
GERMINATION = DEFAULT.but(fill_seq_opportunity=6337.0, fill_seq_direct=1527.0)

# First generation of the model: one mRNA per 1000 proteins, other fills.
EARLY = DEFAULT.but(proteins_per_mrna=1000.0, fill_gene_length=558.0, fill_protein_length=251.0)

# A dormant spore: small protein pool, one re-polymerisation per transcript. The two pool sizes differ by
# two molecules between transcription and translation.
DORMANT = EARLY.but(proteins_per_cell=73411.0, turnover_per_hour=1.0)
DORMANT_TRANSLATION_POOL = 73413.0

# Germination accounting without the length term in transcription opportunity.
LEGACY_GERMINATION = GERMINATION.but(opportunity_uses_length=False)

# Amino acids: symbol, opportunity, direct. Fixed values, in alphabetical order of symbol.
RESIDUE_PRICES = (
    ("A", 12, 4),
    ("C", 19, 8),
    ("D", 13, 4),
    ("E", 19, 4),
    ("F", 48, 5),
    ("G", 11, 4),
    ("H", 18, 10),
    ("I", 31, 6),
    ("K", 29, 6),
    ("L", 30, 4),
    ("M", 27, 11),
    ("N", 13, 7),
    ("P", 23, 5),
    ("Q", 19, 5),
    ("R", 23, 11),
    ("S", 11, 4),
    ("T", 17, 6),
    ("V", 24, 4),
    ("W", 57, 9),
    ("Y", 46, 5),
)

# Names of the processes and kinds a cost row carries.
PROCESSES = ("replication", "transcription", "translation")
KINDS = ("opportunity", "direct")

# Success bands on a relative score; bounds are open and values on a bound or between bands have no band.
SUCCESS_BANDS = (
    ("essential", None, 0.31),
    ("50% failure", 0.31, 0.46),
    ("10% failure", 0.46, 0.83),
    ("90% success", 0.83, None),
)

# 97.5 % quantile of Student's t with 49 degrees of freedom.
T_975_49 = 2.0096

# Bandwidth used for the resampled efficiency density.
EFFICIENCY_BANDWIDTH = 11.35555
# Draws of that density.
RESAMPLED_DRAWS = 1_000_000
