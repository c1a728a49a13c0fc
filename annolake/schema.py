"""Named annotation schemas and what their column names mean."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Columns that record edits, in the order they are added.
CRUD = ("created", "deleted", "superceded_id", "valid")
#: Of those, the ones dropped from results.
HIDDEN = ("created", "deleted", "superceded_id")
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class SchemaSpec:
    """A schema by name: its points' prefixes, its other columns and types, and what it refers to."""

    name: str
    points: tuple[str, ...]
    scalars: tuple[tuple[str, str], ...] = ()
    reference: str | None = None

    def position_columns(self) -> list[str]:
        return [f"{p}_position_{a}" for p in self.points for a in AXES]

    def segmentation_columns(self) -> list[str]:
        return [f"{p}_{kind}_id" for p in self.points for kind in ("supervoxel", "root")]

    def annotation_columns(self) -> list[str]:
        target = ["target_id"] if self.reference else []
        return ["id", *CRUD, *target, *self.position_columns(), *[c for c, _ in self.scalars]]


SYNAPSE = SchemaSpec("synapse", ("pre_pt", "post_pt"), (("tag", "string"), ("size", "double")))
TAG_REFERENCE = SchemaSpec("tag_reference", (), (("label", "string"),), "anno")


@dataclass(frozen=True)
class Table:
    """A table to be queried: its rows, resolution of its positions in nm, and edit columns."""

    name: str
    df: DataFrame
    resolution: tuple[float, float, float] = (1.0, 1.0, 1.0)
    extra: dict = field(default_factory=dict)

    @property
    def points(self) -> list[str]:
        """Position columns without their axis, in the order of the table."""
        return point_columns(self.df.columns)


def point_columns(columns: list[str]) -> list[str]:
    """Bases of columns that come with all three axes."""
    have = set(columns)
    bases = [c[:-2] for c in columns if c.endswith("_x")]
    return [b for b in bases if all(f"{b}_{a}" in have for a in AXES)]


def root_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.endswith("root_id")]


def supervoxel_of(root: str) -> str:
    return root.replace("root_id", "supervoxel_id")


# The order in which a table's main point is looked for when several could serve.
_MAIN = ("ctr", "post", "pre", "pt", "bb")


def point_rank(point: str) -> int:
    """A point's place in that order, by the beginning of its name; others come last."""
    return next((i for i, m in enumerate(_MAIN) if point.startswith(m)), len(_MAIN))


def main_point(columns: list[str]) -> str | None:
    """The point that stands for a row: one with a root first, then by the usual names."""
    points = point_columns(columns)

    def place(p: str) -> tuple[bool, int]:
        return f"{p.removesuffix('_position')}_root_id" not in columns, point_rank(p)

    return min(points, key=place, default=None)
