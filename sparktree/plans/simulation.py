"""The simulation loop, with hooks that applications override."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import gravity, integrate, sph, universe
from ..operators.tables import written


@dataclass
class Simulation:
    """``run`` repeats: forces, kick, hook, drift; each step ends in a written table."""

    config: Config = field(default_factory=Config)

    def before(self, rows: DataFrame) -> DataFrame:
        return rows

    def forces(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ax, ay, az, potential, density, pdv."""
        raise NotImplementedError

    def after(self, rows: DataFrame, iteration: int) -> DataFrame:
        return rows

    def dt(self, rows: DataFrame) -> float:
        return self.config.max_dt

    def step(self, rows: DataFrame, iteration: int = 0) -> DataFrame:
        dt = self.dt(rows)
        pulled = written(self.forces(self.before(rows)), "forces")
        kicked = self.after(integrate.kick(pulled, dt), iteration)
        return written(integrate.drift(kicked, dt), "state")

    def run(self, rows: DataFrame) -> DataFrame:
        for i in range(self.config.iterations):
            rows = self.step(rows, i)
        return rows


def with_forces(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    every = ("ax", "ay", "az", "potential", "density", "pdv")
    bare = rows.drop(*every)
    out = bare.join(found.select("id", *columns), "id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in columns else F.lit(0.0) for c in every})


@dataclass
class GravitySimulation(Simulation):
    theta: float = 0.7
    max_dt: float = 1e-5
    fixed_dt: float | None = None
    last: bool = False

    def forces(self, rows: DataFrame) -> DataFrame:
        found = gravity.hierarchical(rows, self.theta, leaf=self.config.leaf_size, kind=self.config.tree, last=self.last)
        return with_forces(rows, found, "ax", "ay", "az", "potential")

    def dt(self, rows: DataFrame) -> float:
        return self.fixed_dt or universe.time_step(rows, self.max_dt).first()[0]


@dataclass
class SphSimulation(Simulation):
    neighbours: int = 32

    def forces(self, rows: DataFrame) -> DataFrame:
        near = sph.neighbours(rows, self.neighbours)
        dens = written(sph.density(near), "density")
        found = sph.forces(near, dens).join(dens.select("id", "density"), "id", "left")
        return with_forces(rows, found, "ax", "ay", "az", "pdv", "density")


@dataclass
class CollisionSimulation(GravitySimulation):
    start: int = 0

    def after(self, rows: DataFrame, iteration: int) -> DataFrame:
        kept = sph.crop(rows)
        if iteration < self.start:
            return kept
        kept = written(kept, "cropped")
        return sph.resolve(kept, sph.collisions(kept, self.max_dt))
