"""Totals over trailing periods, kept as a versioned daily state in a folder.

A day's total is yesterday's total plus today's arrivals less the amounts that leave the period. ``advance`` takes a
delivery: for days after the state's last one it joins the totals of that day with the arrivals and the expiring
amounts of the new days; for days before it, it adds the differences to the totals that they reach. Both tables are
cut into parts of some days, and only the parts in reach are read and written anew, so a delivery costs what it
reaches, however long the history is. A manifest per version names the parts that are valid, so every version can
be loaded, by any session.

Totals are sparse: an entity has rows on days that hold at least one of its keys in the longest period. The days
between such stretches are filled in by ``trailing``. Sums are decimals, so that adding and removing amounts is exact
and a corrected state equals one built afresh.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.storage import listed, materialize, new_table, read_text, write_text

#: An amount that the state's scale would change by more than this share of it is refused.
LOSS = 1e-6


@dataclass(frozen=True)
class RollingState:
    """One version of a state. ``amounts`` (entity, day, at, tie, fields): the valid row of each key. ``totals``
    (entity, day, version, latest, rows, and per field and period a sum, a count and a count of infinite amounts)."""

    spark: SparkSession = field(repr=False, compare=False)
    path: str
    fields: tuple[str, ...]
    periods: tuple[int, ...]
    scale: int
    part_days: int
    entity: str  # type of the entity
    version: int = 0
    end: int | None = None  # last day of the totals, as days since 1970
    amount_parts: dict[int, int] = field(default_factory=dict)  # part to the version that wrote it
    total_parts: dict[int, int] = field(default_factory=dict)

    # making and loading

    @classmethod
    def create(cls, spark: SparkSession, path: str, fields: tuple[str, ...], periods: tuple[int, ...] = (7, 30), scale: int = 12, part_days: int = 30, entity: str = "string") -> RollingState:
        """An empty state in ``path``, a folder that all executors share. ``part_days`` days of a table are one part."""
        return cls(spark, path.rstrip("/"), tuple(fields), tuple(periods), scale, part_days, entity)._kept()

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> RollingState:
        """The newest version of a state, or an older one."""
        path = path.rstrip("/")
        found = [int(n[9:-5]) for n in listed(spark, path) if n.startswith("manifest-")]
        m = json.loads(read_text(spark, f"{path}/manifest-{max(found) if version is None else version}.json"))
        parts = lambda name: {int(k): v for k, v in m[name].items()}
        return cls(spark, path, tuple(m["fields"]), tuple(m["periods"]), m["scale"], m["part_days"], m["entity"], m["version"], m["end"], parts("amount_parts"), parts("total_parts"))

    @classmethod
    def build(cls, rows: DataFrame, fields: tuple[str, ...], periods: tuple[int, ...] = (7, 30), path: str | None = None, **how) -> RollingState:
        """State of ``rows`` as in ``advance``; without ``path`` it goes when the application ends."""
        spark = rows.sparkSession
        return cls.create(spark, path or new_table(spark, "rolling"), fields, periods, entity=rows.schema["entity"].dataType.simpleString(), **how).advance(rows)

    def _kept(self) -> RollingState:
        names = ("fields", "periods", "scale", "part_days", "entity", "version", "end", "amount_parts", "total_parts")
        write_text(self.spark, f"{self.path}/manifest-{self.version}.json", json.dumps({n: getattr(self, n) for n in names}))
        return self

    # columns

    @property
    def _sum(self) -> str:
        return f"decimal(38,{self.scale})"

    @property
    def _columns(self) -> dict[str, str]:
        """Additive columns of the totals and their types."""
        out = {"rows": "bigint"}
        for f in self.fields:
            for w in self.periods:
                out |= {_s(f, w): self._sum, _n(f, w): "bigint", _i(f, w): "bigint"}
        return out

    def _added(self, rows: DataFrame, keys: list[str], **more: Column) -> DataFrame:
        return rows.groupBy(*keys).agg(*[x.alias(c) for c, x in more.items()], *[F.sum(c).cast(t).alias(c) for c, t in self._columns.items()])

    def _part(self, day: Column | str) -> Column:
        return F.floor(F.unix_date(day) / self.part_days).cast("int")

    # tables

    def _read(self, table: str, parts: set[int] | None = None) -> DataFrame:
        kept = self.amount_parts if table == "amounts" else self.total_parts
        paths = [f"{self.path}/{table}/version={v}/part={p}" for p, v in sorted(kept.items()) if parts is None or p in parts]
        if table == "amounts":
            schema = f"entity {self.entity}, day date, at bigint, tie bigint, " + ", ".join(f"`{f}` double" for f in self.fields)
        else:
            schema = f"entity {self.entity}, day date, version int, latest date, " + ", ".join(f"`{c}` {t}" for c, t in self._columns.items())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, table: str, version: int, parts: int) -> dict[int, int]:
        """Write a version of about so many parts; returns which."""
        path = f"{self.path}/{table}/version={version}"
        df = df.withColumn("part", self._part("day"))
        if parts > 2:
            # else every task would write a small file of every part; large parts are split, small ones joined
            df = df.hint("rebalance", "part")
        df.write.mode("overwrite").partitionBy("part").parquet(path)
        return {int(n[5:]): version for n in listed(self.spark, path) if n.startswith("part=")}

    @property
    def totals(self) -> DataFrame:
        return self._read("totals")

    @property
    def amounts(self) -> DataFrame:
        return self._read("amounts")

    # deliveries

    def advance(self, rows: DataFrame) -> RollingState:
        """The next version, with the delivery ``rows(entity, day, at, tie, fields...)``, new, late or revised.

        Of several rows with one (entity, day) the one with the largest (at, tie) is valid, its NULLs included, whenever
        it came. NULL and NaN fields add nothing, infinite ones make the totals of their periods infinite (or NaN, if
        of both signs); rows with a NULL entity or day are left out; no rows change nothing. Amounts that don't fit
        the scale raise an error. Rows of totals that nothing touches keep their version.
        """
        version, longest = self.version + 1, max(self.periods)
        came = materialize(_valid(rows, self.fields), "came")
        days = sorted(r.d for r in came.select(F.unix_date("day").alias("d")).distinct().collect())  # one row a calendar day at most
        if not days:
            return replace(self, version=version)._kept()
        part = lambda d: d // self.part_days
        touched = set(map(part, days))
        held = touched & self.amount_parts.keys()
        merged = self._merged(came, held)
        amounts = replace(self, amount_parts=self.amount_parts | self._write(merged.select("entity", "day", "at", "tie", *self.fields), "amounts", version, len(touched)))

        end = self.end if self.end is not None else days[0] - 1
        new_end = max(end, days[-1])
        reach = {part(x) for d in days if d <= end for x in range(d, min(d + longest, end + 1))} & self.total_parts.keys()
        opening = {part(end)} & self.total_parts.keys() if new_end > end else set()
        past = self._read("totals", reach | opening)
        if days[0] <= end:
            late = self._spread(merged.filter(F.col("touched") & (F.unix_date("day") <= end)), end).withColumn("version", F.lit(version))
            past = materialize(self._added(past.unionByName(late), ["entity", "day"], version=F.max("version"), latest=F.max("latest")), "past")
        if new_end > end:
            block = self._block(amounts, past.filter(F.unix_date("day") == end), end, new_end).withColumn("version", F.lit(version))
            past = past.unionByName(block)
        written = self._write(past, "totals", version, len(reach) + part(new_end) - part(end))
        return replace(amounts, version=version, end=new_end, total_parts=self.total_parts | written)._kept()

    def _merged(self, came: DataFrame, held: set[int]) -> DataFrame:
        """Valid rows of the parts that the delivery touches, with what each key held before and whether it came."""
        now, names = F.struct("at", "tie", *self.fields), ["at", "tie", *self.fields]
        if not held:
            return came.select("entity", "day", *names, F.lit(True).alias("touched"), F.lit(False).alias("known"), *[F.lit(None).cast("double").alias(_old(f)) for f in self.fields])
        both = self._read("amounts", held).withColumn("late", F.lit(False)).unionByName(came.withColumn("late", F.lit(True)))
        found = both.groupBy("entity", "day").agg(F.max(now).alias("r"), F.bool_or("late").alias("touched"), F.bool_or(~F.col("late")).alias("known"), *[F.max(F.when(~F.col("late"), F.col(f))).alias(_old(f)) for f in self.fields])
        return materialize(found.select("entity", "day", "r.*", "touched", "known", *[_old(f) for f in self.fields]), "merged")

    def _amount(self, name: str) -> Column:
        """A finite amount as decimal; an error if the scale can't hold it."""
        x = F.col(name)
        exact = x.try_cast(self._sum)
        kept = F.coalesce(F.abs(exact.cast("double") - x) <= LOSS * F.abs(x), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit(f"an amount of {name} does not fit {self.scale} places: "), x.cast("string"))).cast(self._sum)
        return F.when(_finite(x), F.when(kept, exact).otherwise(wrong)).otherwise(F.lit(0).cast(self._sum))

    def _terms(self, name: str) -> tuple[Column, Column, Column]:
        """Sum, count and infinities of one amount: positive ones count 1, negative ones 2 ** 32."""
        x = F.col(name)
        wild = F.when(x == float("inf"), 1).when(x == float("-inf"), 1 << 32).otherwise(0).cast("bigint")
        return self._amount(name), (x.isNotNull() & ~F.isnan(x)).cast("bigint"), wild

    def _spread(self, rows: DataFrame, end: int) -> DataFrame:
        """What delivered keys add to the totals up to ``end`` whose periods hold them: as many rows as the longest period a key."""
        add = rows.select("entity", "day", F.col("known"), *[x for f in self.fields for x in self._differences(f)])
        to = F.least(F.date_add("day", max(self.periods) - 1), F.date_from_unix_date(F.lit(end)))
        add = add.withColumn("to", F.explode(F.sequence("day", to)))
        within = lambda w, x, t: F.when(F.datediff("to", "day") < w, x).otherwise(F.lit(0)).cast(t)
        out = [(~F.col("known")).cast("bigint").alias("rows")]
        for f in self.fields:
            for w in self.periods:
                out += [within(w, F.col(f"s_{f}"), self._sum).alias(_s(f, w)), within(w, F.col(f"n_{f}"), "bigint").alias(_n(f, w)), within(w, F.col(f"i_{f}"), "bigint").alias(_i(f, w))]
        return add.select("entity", F.col("to").alias("day"), F.col("day").alias("latest"), *out)

    def _differences(self, f: str) -> list[Column]:
        return [F.coalesce(a, F.lit(0)).cast(t).__sub__(F.coalesce(b, F.lit(0)).cast(t)).cast(t).alias(f"{k}_{f}") for a, b, t, k in zip(self._terms(f), self._terms(_old(f)), (self._sum, "bigint", "bigint"), "sni")]

    def _block(self, amounts: RollingState, opening: DataFrame, end: int, new_end: int) -> DataFrame:
        """Totals of the days after ``end`` up to ``new_end``: the totals of ``end``, joined with what arrives and what expires.

        One exchange by entity, of each amount once and of the opening totals; an entity has at most three changes a day.
        """
        longest = max(self.periods)
        day = F.unix_date("day")
        held = amounts._read("amounts", {d // self.part_days for d in range(end + 1 - longest, new_end + 1)}).filter(day > end - longest)
        nothing = {c: F.lit(None).cast(t).alias(c) for c, t in self._columns.items()}
        rows = held.select("entity", "day", F.lit(None).cast("date").alias("latest"), F.lit(False).alias("open"), *self.fields, *nothing.values())
        rows = rows.unionByName(opening.select("entity", "day", "latest", F.lit(True).alias("open"), *[F.lit(None).cast("double").alias(f) for f in self.fields], *self._columns))
        # a kind of change: the opening totals (-1), an arrival (0), or the period that an amount leaves
        kinds = F.array(*[F.when(~F.col("open") & (day + w > end) & (day + w <= new_end), F.lit(w)) for w in (0, *self.periods)], F.when(F.col("open"), F.lit(-1)))
        terms = [x.alias(f"{k}_{f}") for f in self.fields for x, k in zip(self._terms(f), "sni")]
        rows = rows.repartition("entity").select("entity", "day", "latest", "open", *self._columns, *terms).withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).withColumn("at", F.date_add("day", F.greatest("kind", F.lit(0))))
        sign = lambda w: F.when(F.col("kind") == 0, 1).when(F.col("kind") == w, -1).otherwise(0)
        change = {"rows": sign(longest)}
        for f in self.fields:
            s, n, i = (F.col(f"{k}_{f}") for k in "sni")
            for w in self.periods:
                change |= {_s(f, w): F.when(F.col("kind") == 0, s).when(F.col("kind") == w, -s), _n(f, w): n * sign(w), _i(f, w): i * sign(w)}
        both = [F.coalesce(F.col(c), change[c], F.lit(0)).cast(t).alias(c) for c, t in self._columns.items()]
        latest = F.when(F.col("kind") == 0, F.col("day")).otherwise(F.col("latest")).alias("latest")
        changes = self._added(rows.select("entity", F.col("at").alias("day"), latest, *both), ["entity", "day"], latest=F.max("latest"))
        order = Window.partitionBy("entity").orderBy("day")
        running = order.rowsBetween(Window.unboundedPreceding, 0)
        sums = changes.select("entity", "day", F.max("latest").over(running).alias("latest"), F.lead("day").over(order).alias("next"), *[F.sum(c).over(running).cast(t).alias(c) for c, t in self._columns.items()])
        stop = F.coalesce(F.date_sub("next", 1), F.date_from_unix_date(F.lit(new_end)))
        days = sums.filter("rows > 0").withColumn("day", F.explode(F.sequence("day", stop)))
        return days.filter(day > end).select("entity", "day", "latest", *self._columns)

    # results

    def trailing(self) -> DataFrame:
        """(entity, day, <field>_sum_<period>, <field>_mean_<period>...) of every day from an entity's first to its last row.

        NULL where the period holds no value.
        """
        every = Window.partitionBy("entity")
        rows = self.totals.withColumn("__last", F.max("latest").over(every)).withColumn("__next", F.lead("day").over(every.orderBy("day"))).filter("day <= __last")
        stop = F.coalesce(F.date_sub(F.least("__next", F.date_add("__last", 1)), 1), F.col("day"))
        rows = rows.withColumn("__day", F.explode(F.sequence("day", stop)))
        out: list[Column] = []
        for f in self.fields:
            for w in self.periods:
                n, wild = F.when(F.col("__day") == F.col("day"), F.col(_n(f, w))), F.col(_i(f, w))
                up, down = wild % (1 << 32), F.floor(wild / (1 << 32))
                s = F.when((up > 0) & (down > 0), float("nan")).when(up > 0, float("inf")).when(down > 0, float("-inf")).otherwise(F.col(_s(f, w)).cast("double"))
                out += [F.when(n > 0, s).alias(f"{f}_sum_{w}"), F.when(n > 0, s / F.when(n > 0, n)).alias(f"{f}_mean_{w}")]
        return rows.select("entity", F.col("__day").alias("day"), *out)


def as_of(day: datetime.date) -> int:
    """A date as the days since 1970 that ``RollingState.end`` counts."""
    return (day - datetime.date(1970, 1, 1)).days


def _s(field: str, period: int) -> str:
    return f"{field}_{period}_sum"


def _n(field: str, period: int) -> str:
    return f"{field}_{period}_n"


def _i(field: str, period: int) -> str:
    return f"{field}_{period}_wild"


def _old(field: str) -> str:
    return f"{field}__old"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _valid(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The row of each key that counts: the largest (at, tie), of equal ones the larger fields."""
    at = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62)))
    amounts = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in fields]
    rows = rows.filter("entity is not null and day is not null").select("entity", F.col("day").cast("date").alias("day"), at.alias("at"), F.coalesce(F.col("tie").cast("bigint"), F.lit(-(1 << 62))).alias("tie"), *amounts)
    return rows.groupBy("entity", "day").agg(F.max(F.struct("at", "tie", *fields)).alias("r")).select("entity", "day", "r.*")
