"""YAML settings, search profiles, skill lists, and the occupation taxonomy."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.schemas import TAXONOMY


def _yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


@dataclass
class Location:
    label: str
    lat: float | None = None
    lon: float | None = None
    postal_code: str | None = None
    radius_km: float = 25.0


@dataclass
class Profile:
    """A search profile: what to rank for."""

    name: str
    display_name: str = ""
    cv_text: str = ""
    target_roles: list[dict] = field(default_factory=list)
    locations: list[Location] = field(default_factory=list)
    workload_min: int = 80
    workload_max: int = 100
    keywords_positive: list[str] = field(default_factory=list)
    keywords_exclude: list[str] = field(default_factory=list)
    wants_home_office: bool = False
    wants_flextime: bool = False
    include_agencies: bool = True
    occupation_prefixes: list[str] = field(default_factory=list)
    description_languages: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 1.0, "workload": 0.5, "location": 0.8, "home_office": 0.3, "flextime": 0.3, "keywords": 0.5, "recency": 0.2, "agency": 0.35, "exclude": 1.0})

    def __post_init__(self) -> None:
        self.locations = [x if isinstance(x, Location) else Location(**x) for x in self.locations]
        if self.workload_max < self.workload_min:
            raise ValueError("workload_max is below workload_min")


def load_profile(path: str) -> Profile:
    known = set(Profile.__dataclass_fields__)
    return Profile(**{k: v for k, v in _yaml(path).items() if k in known})


def list_profiles(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.yaml"))


def load_skills(path: str) -> dict[str, dict[str, list[str]]]:
    """Category → skill → aliases; entries are plain names or {name: [aliases]}."""
    out: dict[str, dict[str, list[str]]] = {}
    for category, entries in _yaml(path).items():
        skills = out.setdefault(category, {})
        for entry in entries or []:
            if isinstance(entry, dict):
                skills.update({str(k): [str(a) for a in v or []] for k, v in entry.items()})
            else:
                skills[str(entry)] = []
    return out


def skills_table(spark: SparkSession, skills: dict[str, dict[str, list[str]]]) -> DataFrame:
    rows = [(c, name, aliases) for c, names in skills.items() for name, aliases in names.items()]
    return spark.createDataFrame(rows, "category string, skill string, aliases array<string>")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Occupation records reduced to one row each; without id or title they are dropped."""
    raw = spark.read.schema(TAXONOMY).option("multiLine", True).json(path)
    return raw.select(
        "job_id", "title", "description",
        F.get(F.col("categories.berufsfelder"), F.lit(0)).alias("berufsfeld"),
        F.array_join("categories.branchen", "; ").alias("branchen"),
        F.col("categories.swissdoc").alias("swissdoc"),
        F.get(F.col("categories.bildungstypen"), F.lit(0)).alias("bildungstyp"),
        F.col("taetigkeiten.kategorien").alias("taetigkeiten"),
        F.transform("weitere_informationen.verwandte_berufe", lambda b: b["title"]).alias("verwandte_berufe"),
        F.col("weiterbildung.career_progression").alias("career_progression"),
    ).where((F.coalesce("job_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).dropDuplicates(["job_id"])


def activity_vocabulary(taxonomy: DataFrame, top: int = 60) -> DataFrame:
    """The most frequent names of activity categories, 4 to 45 characters long."""
    names = taxonomy.select(F.explode(F.map_keys("taetigkeiten")).alias("name")).where(F.length("name").between(4, 45))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(top)


def career_hints(taxonomy: DataFrame, title: str) -> DataFrame:
    """The first three steps of an occupation's progression with their first option."""
    steps = F.transform(F.slice("career_progression", 1, 3), lambda s: F.struct(s["level"].alias("level"), s["type"].alias("type"), F.get(s["options"], F.lit(0)).alias("option")))
    return taxonomy.where(F.lower("title") == title.lower()).select(F.explode(steps).alias("s")).select("s.*")
