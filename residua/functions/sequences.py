"""Column functions over protein sequences. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The twenty standard residues, in the order of the composition vector.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Residues of a sequence that an embedder reads.
MAX_RESIDUES = 1022
#: The composition features in order.
FEATURES = [*(f"aa_{r}" for r in RESIDUES), "len_k"]
#: Columns that live within an operator only.
UPPER, LENGTH = "__sequence_upper", "__sequence_length"


def clean_sequence(seq: Column) -> Column:
    """J and j become L, stops go."""
    return F.translate(seq, "Jj*", "LL")


def clean_body(body: Column) -> Column:
    """clean_sequence of a record's body, whose line ends and blanks also go."""
    return F.translate(body, "Jj*\n\r\t ", "LL")


def truncate(seq: Column, residues: int = MAX_RESIDUES) -> Column:
    return F.substring(seq, 1, residues)


def seq_length(seq: Column) -> Column:
    return F.length(F.upper(seq)).cast("bigint")


def residue_count(upper: Column, residue: str) -> Column:
    """Of a text in upper case. Residues are single bytes, so lengths in bytes will do."""
    return (F.octet_length(upper) - F.octet_length(F.replace(upper, F.lit(residue), F.lit("")))).cast("bigint")


def _with_upper(df: DataFrame, sequence: str) -> DataFrame:
    """Upper case and length in projections of their own, so that each row has them made once."""
    return df.withColumn(UPPER, F.upper(sequence)).withColumn(LENGTH, F.length(UPPER).cast("bigint"))


def _generated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns as a generator's: a filter on what is made of them stays above and doesn't compute them again."""
    kept = [c for c in df.columns if c not in (UPPER, LENGTH, *columns)]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_residue_counts(df: DataFrame, sequence: str) -> DataFrame:
    """Adds n_A .. n_Y."""
    return _generated(_with_upper(df, sequence), {f"n_{r}": residue_count(F.col(UPPER), r) for r in RESIDUES})


def with_composition(df: DataFrame, sequence: str) -> DataFrame:
    """Adds the frequencies aa_A .. aa_Y of the whole length and len_k; all zero for an empty sequence, len_k null for a null one."""
    share = {f"aa_{r}": F.coalesce(F.try_divide(residue_count(F.col(UPPER), r), F.col(LENGTH)), F.lit(0.0)) for r in RESIDUES}
    return _generated(_with_upper(df, sequence), share | {"len_k": F.col(LENGTH) / F.lit(1000.0)})


def format_probability(p: Column, digits: int = 4) -> Column:
    """Rounded as a C printf does: the double's exact value counts, and exact halves go to even digits.

    A double is cut into halves whose products with the scale are exact, so that the signs of the
    remainders are. Not-a-number is "nan"; values from a million on are formatted by their shortest digits.
    """
    scale = 10**digits
    x = F.abs(p)
    wide = x * F.lit(134217729.0)  # 2^27 + 1
    high = wide - (wide - x)
    low = (x - high) * F.lit(2.0 * scale)
    guess = F.floor(x * F.lit(float(scale)))
    over = high * F.lit(2.0 * scale) - guess * 2  # twice the remainder, but for ``low``
    whole = guess + F.when(over + low < 0, -1).when((over - 2) + low >= 0, 1).otherwise(0)
    past = (high * F.lit(2.0 * scale) - whole * 2 - 1) + low
    units = whole + F.when((past > 0) | ((past == 0) & (whole % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(p < 0, "-").otherwise(""), F.floor(units / scale).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), digits, "0"))
    return F.when(F.isnan(p), "nan").when(x < 1e6, text).otherwise(F.format_string(f"%.{digits}f", p))


def batch_size_rule(memory_gib: Column, model: Column) -> Column:
    """Sequences in a batch for an accelerator's memory: by the 8M model, the 35M model and any other."""
    gib = memory_gib.cast("bigint")
    return (
        F.when(model == "t6_8M", F.least(F.greatest(F.floor(gib / 2), F.lit(4)), F.lit(32)))
        .when(model == "t12_35M", F.least(F.greatest(F.floor(gib / 4), F.lit(2)), F.lit(16)))
        .otherwise(F.least(F.greatest(F.floor(gib / 3), F.lit(2)), F.lit(8)))
        .cast("bigint")
    )
