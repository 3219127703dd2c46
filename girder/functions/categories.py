"""What the classes mean: families, labels and the legend (PRJ-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.rules import refuse

#: The classes of the segmentation source in canonical order, the families of all classes, and what is shown for them.
CLASS_NAMES = ("crack", "surface_loss")
FAMILIES = {
    "crack": "crack",
    "surface_loss": "surface_damage",
    "peeling_paint": "surface_damage",
    "moisture_trace": "moisture_trace",
    "mold_suspected": "mold_suspected",
}
LABELS = {
    "crack": "Fissures",
    "surface_loss": "Pertes de matière",
    "mold_suspected": "Moisissures suspectées",
    "moisture_trace": "Traces compatibles avec l'humidité",
    "peeling_paint": "Revêtement écaillé ou décollé",
    "surface_damage": "Éclats et dégradation du revêtement",
}
LEGEND = {"crack": "Rouge : fissure", "surface_loss": "Bleu : perte de matière"}
COLLECTION_CLASSES = ("mold_suspected", "moisture_trace", "peeling_paint")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def is_class(name: Column) -> Column:
    return F.coalesce(name.isin(*FAMILIES), F.lit(False))


def family(name: Column) -> Column:
    return lookup(name, FAMILIES)


def label(name: Column) -> Column:
    """What is shown for a class or family."""
    return lookup(name, LABELS)


def legend(names: tuple[str, ...]) -> str:
    return " · ".join(LEGEND[n] for n in names)


def with_category(table: DataFrame, name: str = "class") -> DataFrame:
    """Add a class's family and label; unknown classes are refused."""
    refuse(table.where(~is_class(F.col(name))).select(name).distinct(), "unknown defect class")
    return table.withColumns({"family": family(F.col(name)), "label": label(F.col(name))})
