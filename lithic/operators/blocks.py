"""Block sets: blocks of several sizes on an integer lattice, as rows (block_id, ox, oy, oz, level)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = ("ox", "oy", "oz")
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class BlockSet:
    """Level 0 blocks measure `step`; each level divides a side by `discretization`. Origins are counted in
    sides of the finest level. `start` is the centre of the first level 0 block."""

    start: tuple[float, float, float]
    n: tuple[int, int, int]
    step: tuple[float, float, float]
    discretization: tuple[int, int, int] = (2, 2, 2)
    max_levels: int = 3

    def side(self, axis: int, level: Column | int) -> Column:
        """Side of a block in finest units."""
        d = self.discretization[axis]
        return F.pow(F.lit(d), F.lit(self.max_levels) - level).cast("long") if isinstance(level, Column) else F.lit(d ** (self.max_levels - level))

    @property
    def base(self) -> tuple[int, ...]:
        """Finest cells per axis of the whole box."""
        return tuple(n * d**self.max_levels for n, d in zip(self.n, self.discretization))

    def unit(self, axis: int) -> float:
        return self.step[axis] / self.discretization[axis] ** self.max_levels

    def rows(self, spark: SparkSession) -> DataFrame:
        """All blocks at level 0."""
        i = F.col("block_id")
        at = [F.pmod(i, F.lit(self.n[0])), F.pmod(F.floor(i / self.n[0]), F.lit(self.n[1])), F.floor(i / (self.n[0] * self.n[1]))]
        side = [d**self.max_levels for d in self.discretization]
        return spark.range(math.prod(self.n)).withColumnRenamed("id", "block_id").select("block_id", *((a * s).cast("long").alias(o) for a, s, o in zip(at, side, ORIGIN)), F.lit(0).alias("level"))

    def with_size(self, blocks: DataFrame) -> DataFrame:
        """Blocks with centre, size per axis and volume."""
        size = [self.side(k, F.col("level")) * self.unit(k) for k in range(3)]
        centre = [F.col(o) * self.unit(k) + size[k] / 2 + (self.start[k] - self.step[k] / 2) for k, o in enumerate(ORIGIN)]
        return blocks.withColumns({**{c: v for c, v in zip(AXES, centre)}, **{f"d{c}": v for c, v in zip(AXES, size)}, "volume": size[0] * size[1] * size[2]})

    def split(self, blocks: DataFrame, mask: Column) -> DataFrame:
        """Marked blocks replaced by their children, which inherit other columns; `fresh` marks the children.

        A block of the finest level can't be split.
        """
        level = F.when(F.col("level") < self.max_levels, F.col("level")).otherwise(F.raise_error(F.lit("the finest blocks can't be split")).cast("int"))
        subs = [p[::-1] for p in product(*(range(d) for d in self.discretization[::-1]))]
        offsets = F.array(*(F.struct(F.lit(i).alias("sub"), *(F.lit(v).cast("long").alias(o) for v, o in zip(p, ORIGIN))) for i, p in enumerate(subs)))
        kept = blocks.where(~mask).withColumn("fresh", F.lit(False))
        made = blocks.where(mask).withColumn("level", level + 1).withColumn("__o", F.explode(offsets))
        made = made.withColumns({o: F.col(o) + F.col(f"__o.{o}") * self.side(k, F.col("level")) for k, o in enumerate(ORIGIN)}).drop("__o")
        return kept.unionByName(made.withColumn("fresh", F.lit(True)))

    def parent(self, level: Column) -> list[Column]:
        """Origin of a block's parent."""
        return [F.col(o) - F.pmod(F.col(o), self.side(k, level - 1)) for k, o in enumerate(ORIGIN)]

    def group(self, blocks: DataFrame, mask: Column, first: list[str] = ()) -> DataFrame:
        """Marked sibling families replaced by their parents, with other columns from the first child.

        Only whole families can be grouped; a part of one is an error.
        """
        keys = [p.alias(f"p_{o}") for p, o in zip(self.parent(F.col("level")), ORIGIN)]
        order = F.struct(*reversed(ORIGIN))
        whole = math.prod(self.discretization)
        families = blocks.where(mask).groupBy(*keys, "level").agg(F.count("*").alias("__n"), *(F.min_by(c, order).alias(c) for c in first))
        checked = F.when((F.col("__n") == whole) & (F.col("level") > 0), F.col("level") - 1).otherwise(F.raise_error(F.lit("only whole families can be grouped")).cast("int"))
        made = families.select(*(F.col(f"p_{o}").alias(o) for o in ORIGIN), checked.alias("level"), *first, F.lit(True).alias("fresh"))
        return blocks.where(~mask).select(*ORIGIN, "level", *first, F.lit(False).alias("fresh")).unionByName(made)

    def keys(self, level: int) -> list[Column]:
        """Origin of the block of a level that would hold a point; lower faces belong to a block."""
        out = []
        for k, c in enumerate(AXES):
            fine = F.floor((F.col(c) - (self.start[k] - self.step[k] / 2)) / self.unit(k)).cast("long")
            out.append(fine - F.pmod(fine, self.side(k, level)))
        return out

    def locate(self, points: DataFrame, blocks: DataFrame) -> DataFrame:
        """Points with the block_id that holds them, null outside: one equi-join over (level, ancestor key)."""
        candidates = F.array(*(F.struct(F.lit(lv).alias("level"), *(k.alias(o) for k, o in zip(self.keys(lv), ORIGIN))) for lv in range(self.max_levels + 1)))
        tagged = points.withColumn("__p", F.monotonically_increasing_id())
        asked = tagged.select("*", F.explode(candidates).alias("__k")).select("*", *(F.col(f"__k.{c}").alias(f"__{c}") for c in ("level", *ORIGIN))).drop("__k")
        b = blocks.select(F.col("block_id"), *(F.col(c).alias(f"__{c}") for c in ("level", *ORIGIN)))
        joined = asked.join(b, [f"__{c}" for c in ("level", *ORIGIN)], "left")
        names = points.columns
        # Blocks tile their box, so at most one of a point's candidates is there.
        return joined.groupBy("__p").agg(*(F.first(c).alias(c) for c in names), F.max("block_id").alias("block_id")).drop("__p")

    def sub_rows(self, blocks: DataFrame) -> DataFrame:
        """block_id, sub and centre of every sub-block."""
        sized = self.with_size(blocks)
        subs = [p[::-1] for p in product(*(range(d) for d in self.discretization[::-1]))]
        shares = F.array(*(F.struct(F.lit(i).alias("sub"), *(F.lit((v + 0.5) / d - 0.5).alias(c) for v, d, c in zip(p, self.discretization, AXES))) for i, p in enumerate(subs)))
        return sized.withColumn("__s", F.explode(shares)).select("block_id", "__s.sub", *((F.col(c) + F.col(f"__s.{c}") * F.col(f"d{c}")).alias(c) for c in AXES))

    def unbalanced(self, blocks: DataFrame, gap: int = 1) -> DataFrame:
        """Blocks with a face neighbour more than `gap` levels finer.

        Each block asks, through each face, for every coarser level's block that would hold the cell just
        across it: equi-joins on ancestor keys only.
        """
        faces = [(k, s) for k in range(3) for s in (-1, 1)]
        asked = None
        for k, s in faces:
            across = [F.col(o) + (self.side(k, F.col("level")) if s > 0 else F.lit(-1)) if i == k else F.col(o) for i, o in enumerate(ORIGIN)]
            for up in range(0, self.max_levels - gap):
                fine = blocks.where(F.col("level") > up + gap)
                keys = [(a - F.pmod(a, self.side(i, up))).alias(f"k_{o}") for i, (a, o) in enumerate(zip(across, ORIGIN))]
                some = fine.select(*keys, F.lit(up).alias("k_level"))
                asked = some if asked is None else asked.union(some)
        if asked is None:
            return blocks.where(F.lit(False))
        asked = asked.distinct()
        return blocks.join(asked, [blocks[o] == asked[f"k_{o}"] for o in ORIGIN] + [blocks["level"] == asked["k_level"]], "left_semi")

    def is_full(self, blocks: DataFrame) -> bool:
        """Whether the blocks tile the box: their base cells add up to it and no block lies in another one."""
        cells = self.side(0, F.col("level")) * self.side(1, F.col("level")) * self.side(2, F.col("level"))
        if (blocks.agg(F.sum(cells)).first()[0] or 0) != math.prod(self.base):
            return False
        return self.overlapping(blocks).isEmpty()

    def overlapping(self, blocks: DataFrame) -> DataFrame:
        """Blocks that lie in a larger block that is there too, or are there twice."""
        ups = F.array(*(F.struct(F.lit(lv).alias("l"), *((F.col(o) - F.pmod(F.col(o), self.side(k, lv))).alias(o) for k, o in enumerate(ORIGIN))) for lv in range(self.max_levels + 1)))
        asked = blocks.select("*", F.explode(F.filter(ups, lambda u: u["l"] < F.col("level"))).alias("u"))
        b = blocks.select(*(F.col(o).alias(f"b_{o}") for o in ORIGIN), F.col("level").alias("b_level"))
        inside = asked.join(b, [F.col("u.l") == b["b_level"], *(F.col(f"u.{o}") == b[f"b_{o}"] for o in ORIGIN)], "left_semi").select(*ORIGIN, "level")
        twice = blocks.groupBy(*ORIGIN, "level").count().where("count > 1").select(*ORIGIN, "level")
        return inside.union(twice)

    def missing(self, blocks: DataFrame, spark: SparkSession) -> DataFrame:
        """What is not covered, as the largest aligned blocks: level by level, candidates without any block in or above them."""
        todo, out = self.rows(spark).select(*ORIGIN, "level"), None
        for lv in range(self.max_levels + 1):
            same = blocks.where(F.col("level") == lv).select(*ORIGIN)
            todo = todo.join(same, list(ORIGIN), "left_anti")
            below = blocks.where(F.col("level") > lv).select(*((F.col(o) - F.pmod(F.col(o), self.side(k, lv))).alias(o) for k, o in enumerate(ORIGIN))).distinct()
            empty = todo.join(below, list(ORIGIN), "left_anti")
            out = empty if out is None else out.union(empty)
            if lv < self.max_levels:
                todo = self.split(todo.join(below, list(ORIGIN), "left_semi"), F.lit(True)).select(*ORIGIN, "level")
        return out

    def needs_splitting(self, shares: list[str], tolerance: float = 0.05) -> Column:
        """Whether any decision divides a block by more than `tolerance` and it can still be split."""
        top = F.greatest(*map(F.col, shares)) if len(shares) > 1 else F.col(shares[0])
        return (F.coalesce(top, F.lit(0.0)) > tolerance) & (F.col("level") < self.max_levels)

    def grow(self, blocks: DataFrame, mask: Column, rings: int = 1) -> DataFrame:
        """Blocks with `grown`: marked ones and, ring by ring, those that share a corner with them.

        Corners are rows of integers, so each ring is two equi-joins.
        """
        side = [self.side(k, F.col("level")) for k in range(3)]
        sets = F.array(*(F.struct(*((F.col(o) + (s if b >> k & 1 else F.lit(0))).alias(f"c_{o}") for k, (o, s) in enumerate(zip(ORIGIN, side)))) for b in range(8)))
        keys = [f"c_{o}" for o in ORIGIN]
        corner = blocks.select("block_id", F.explode(sets).alias("c")).select("block_id", *(f"c.{k}" for k in keys))
        found = blocks.where(mask).select("block_id")
        for _ in range(rings):
            touched = corner.join(found, "block_id", "left_semi").select(*keys).distinct()
            found = corner.join(touched, keys, "left_semi").select("block_id").distinct()
        return blocks.join(found.withColumn("grown", F.lit(True)), "block_id", "left").withColumn("grown", F.coalesce("grown", F.lit(False)))

    def trilinear_weights(self) -> list[list[float]]:
        """For each sub-block's centre, the weights of the block's eight corners (bit k of a corner's number: its upper side on axis k)."""
        out = []
        for p in (q[::-1] for q in product(*(range(d) for d in self.discretization[::-1]))):
            t = [(i + 0.5) / d for i, d in zip(p, self.discretization)]
            out.append([math.prod(t[k] if c >> k & 1 else 1 - t[k] for k in range(3)) for c in range(8)])
        return out


@dataclass(frozen=True)
class RotatedBlockSet(BlockSet):
    """A block set turned about its first block's centre.

    Splitting, grouping and balancing work on the lattice as it was; coordinates are turned where they
    leave (centres, sub-blocks) and turned back where they come in (points to be located).
    """

    azimuth: float = 0.0
    dip: float = 0.0
    rake: float = 0.0

    @classmethod
    def of(cls, points: DataFrame, step: tuple[float, float, float], discretization: tuple[int, int, int] = (2, 2, 2), max_levels: int = 3, azimuth: float = 0.0, dip: float = 0.0, rake: float = 0.0) -> RotatedBlockSet:
        """The least set with this turn and block size that holds all points (x, y, z)."""
        flat = cls((0.0, 0.0, 0.0), (1, 1, 1), step, discretization, max_levels, azimuth, dip, rake)
        back = flat.to_lattice(points)
        row = back.agg(*(f(c) for c in AXES for f in (F.min, F.max))).first()
        if row[0] is None:
            raise ValueError("there are no points")
        n = tuple(int((high - low) // s) + 1 for low, high, s in zip(row[::2], row[1::2], step))
        first = [low + (high - low) / 2 - (k - 1) * s / 2 for low, high, k, s in zip(row[::2], row[1::2], n, step)]
        matrix = flat.matrix()
        return cls(tuple(sum(first[i] * float(matrix[i][k]) for i in range(3)) for k in range(3)), n, step, discretization, max_levels, azimuth, dip, rake)

    def matrix(self):
        from lithic.functions.geometry import rotation_matrix

        return rotation_matrix(self.azimuth, self.dip, self.rake)

    def _turned(self, df: DataFrame, matrix) -> DataFrame:
        off = [F.col(c) - self.start[i] for i, c in enumerate(AXES)]
        return df.withColumns({c: sum((off[i] * float(matrix[i][k]) for i in range(3)), F.lit(float(self.start[k]))) for k, c in enumerate(AXES)})

    def to_world(self, df: DataFrame) -> DataFrame:
        return self._turned(df, self.matrix())

    def to_lattice(self, df: DataFrame) -> DataFrame:
        return self._turned(df, self.matrix().T)

    def _flat(self) -> BlockSet:
        return BlockSet(self.start, self.n, self.step, self.discretization, self.max_levels)

    def with_size(self, blocks: DataFrame) -> DataFrame:
        """Blocks with their centre in the world, size along their own axes, and volume."""
        return self.to_world(self._flat().with_size(blocks))

    def sub_rows(self, blocks: DataFrame) -> DataFrame:
        return self.to_world(self._flat().sub_rows(blocks))

    def locate(self, points: DataFrame, blocks: DataFrame) -> DataFrame:
        given = points.withColumns({f"__world_{c}": F.col(c) for c in AXES})
        found = self._flat().locate(self.to_lattice(given), blocks)
        return found.withColumns({c: F.col(f"__world_{c}") for c in AXES}).drop(*(f"__world_{c}" for c in AXES))
