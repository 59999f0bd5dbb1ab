"""What a reader asks of the result tables: plain filters and joins, so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import joins
from ..functions import terms as t
from ..functions.text import natural_key


def punchcard(punch: DataFrame, cell_counts: DataFrame, labels: dict[str, str], set_properties: DataFrame | None = None) -> DataFrame:
    """The wide card: cell count, the identities ordered by the name a reader sees, then the sets' own properties."""
    identities = [c for c in punch.columns if c != "setId"]
    ordered = sorted(identities, key=lambda i: (natural_key(labels.get(i, i)), i))
    card = joins.shuffled_join(punch, cell_counts.select("setId", "cellCount"), ["setId"], "left")
    extra: list[str] = []
    if set_properties is not None:
        extra = [c for c in set_properties.columns if c != "setId"]
        card = joins.shuffled_join(card, set_properties, ["setId"], "left")
    return card.select("setId", "cellCount", *[F.col(f"`{c}`") for c in ordered], *[F.col(f"`{c}`") for c in extra])


def punchcard_identity_options(punch: DataFrame, labels: DataFrame) -> DataFrame:
    """(value, label) of the identities the card shows."""
    shown = [c for c in punch.columns if c != "setId"]
    return labels.filter(F.col("identity").isin(shown)).select(F.col("identity").alias("value"), "label")


def panels_differ(sample_panels: DataFrame) -> DataFrame:
    """(samplePanelCount): more than one means cells asked varies by identity and is worth a column."""
    return sample_panels.agg(F.count_distinct("panelId").alias("samplePanelCount"))


def expand_set(verdicts: DataFrame, set_id: str, several_panels: bool = True) -> DataFrame:
    """One set's identities, those never asked left out. Cells asked is shown only where panels differ."""
    asked = ["cellsAsked"] if several_panels else []
    return verdicts.filter((F.col("setId") == set_id) & (F.col("state") != t.NEVER_ASKED)).select(
        "setId", "identity", "state", *asked, "cellsAnswered", "cellsBound"
    )


def expand_cells(cell_punch: DataFrame, set_id: str) -> DataFrame:
    """One set's cells."""
    return cell_punch.filter(F.col("setId") == set_id)


def set_title(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(setId, title): the name with its number of cells; the name alone where the count is missing."""
    joined = labels.join(counts.select("setId", "cellCount"), "setId", "left")
    with_count = F.concat("label", F.lit(" — "), F.col("cellCount").cast("string"), F.lit(" cells"))
    return joined.select("setId", F.coalesce(with_count, "label").alias("title"))
