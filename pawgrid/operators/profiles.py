"""Soft scoring for a table of profiles (SCR1, SCR2, SRT2): the best listings of every profile.

Profiles and listings are dealt into blocks that meet in a grid (``cogroup().applyInPandas``): a cell
sorts its listings by their attributes, cuts them into runs of ``RUN`` rows and keeps of each run what its values
are.  For a profile the best score that a run can hold follows from those; runs are opened from the best
bound down, until no closed one can hold any of the ``n`` best at or above the threshold.  Bounds add up rounded as
scores do, so none is below a score of its run and the rows are those of scoring every pair.  A window over the cells'
rows (with Spark's partial limit before the exchange) gives the answer.  Listings are copied once per profile block and
profiles once per listing block; a cell's memory is bounded by the rows of its blocks.

The scores are those of ``scoring.match_score``, slot by slot in the same order.  Tags and traits are read
once per distinct value of a cell.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.operators.predicates import open_state

BLOCK_ROWS = 16384    # profiles of a block
LISTING_BLOCKS = 16   # a block of listings has so many times more rows: the search in it grows slower than its rows
LEAST_LISTINGS = 256  # listings are not cut into smaller blocks than this to occupy more tasks
RUN = 64              # listings bounded together
FIRST_RUNS = 32       # runs opened at first; each further round opens four times as many
WORD_BYTES = 1 << 25  # kept matches of wanted words with tag lists
TIE_DIGITS = 9        # scores equal to so many decimals tie, and the smaller uid comes first

BAND = "struct<preferred:struct<min:double,max:double>,acceptable:struct<min:double,max:double>>"
BEHAVIOR = "map<string,struct<ideal:double,acceptable:array<double>>>"
PROFILE_SCHEMA = (f"profile_id long, region array<string>, age_preference {BAND}, size_preference {BAND}, "
                  f"personality_traits array<string>, behavior_preferences {BEHAVIOR}, weights map<string,double>")
SLOTS = ("region", "age_preference", "size_preference", "personality_traits", "behavior_preferences")


def profile_table(spark: SparkSession, profiles: dict[int, dict]) -> DataFrame:
    """Profiles given as dicts (see ``scoring.default_profile``) as a table of ``PROFILE_SCHEMA``.

    A slot left out is null.  In a band a bound left out becomes 0 or 100, as the source has it; a bound of
    None stays null, which is no bound."""
    def band(pref: dict | None):
        if pref is None:
            return None
        return tuple((pref.get(kind, {}).get("min", 0), pref.get(kind, {}).get("max", 100)) for kind in ("preferred", "acceptable"))

    def number(x):
        return None if x is None else float(x)

    rows = []
    for pid, p in profiles.items():
        bands = [tuple(tuple(map(number, b)) for b in band(p[s])) if s in p else None for s in ("age_preference", "size_preference")]
        behavior = {name: (number(v.get("ideal")), [float(x) for x in v.get("acceptable", [])])
                    for name, v in p["behavior_preferences"].items()} if "behavior_preferences" in p else None
        rows.append((pid, p.get("region"), *bands, p.get("personality_traits"), behavior,
                     {k: float(v) for k, v in p.get("weights", {}).items()}))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


# ----------------------------------------------------------------------------------------------
# One cell
# ----------------------------------------------------------------------------------------------
def _list(x) -> list:
    return [] if x is None else list(x)


def _pairs(x) -> list:
    """The entries of a map, however it arrives."""
    return [] if x is None else list(x.items()) if isinstance(x, dict) else list(x)


def _field(x, name: str, place: int):
    return x[name] if isinstance(x, dict) else x[place]


def _missing(x) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def _number(x) -> float:
    return math.nan if x is None else float(x)


def _edges(pref, kind: int, name: str) -> tuple[float, float]:
    """The bounds of one band of a preference; a bound that is missing is infinite."""
    lo, hi = (_field(_field(pref, name, kind), b, i) for i, b in enumerate(("min", "max")))
    return -np.inf if _missing(lo) else lo, np.inf if _missing(hi) else hi


class Category:
    """A column of few distinct values: a code per listing, and the codes that occur in each run."""

    def __init__(self, codes: np.ndarray, n_values: int) -> None:
        self.codes, self.n_values = codes, n_values

    def cut(self, order: np.ndarray, run: np.ndarray) -> None:
        self.codes = self.codes[order]
        pairs = np.unique(run * np.int64(max(self.n_values, 1)) + self.codes)
        self.held, at = pairs % max(self.n_values, 1), pairs // max(self.n_values, 1)
        self.first = np.searchsorted(at, np.arange(run[-1] + 1)) if len(run) else np.zeros(0, np.int64)
        self.mixed = len(self.held) > 8 * len(self.first)  # runs hold about everything: one bound for all

    def tops(self, table: np.ndarray):
        """The largest value of ``table`` (by code) in each run, or in all of them."""
        return table.max() if self.mixed else np.maximum.reduceat(table[self.held], self.first)


class Amount:
    """A column of numbers, with the range of each run."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values

    def cut(self, order: np.ndarray, starts: np.ndarray) -> None:
        self.values = self.values[order]
        none = np.isnan(self.values)
        self.low = np.minimum.reduceat(np.where(none, np.inf, self.values), starts)
        self.high = np.maximum.reduceat(np.where(none, -np.inf, self.values), starts)
        self.gaps = np.maximum.reduceat(none, starts)

    def band(self, pref, rows: np.ndarray) -> np.ndarray:
        v = self.values[rows]
        out = np.zeros(len(v))
        for value, kind, name in ((0.7, 1, "acceptable"), (1.0, 0, "preferred")):
            lo, hi = _edges(pref, kind, name)
            out[(v >= lo) & (v <= hi)] = value
        out[np.isnan(v)] = 0.5
        return out

    def tops(self, pref) -> np.ndarray:
        out = np.where(self.gaps, 0.5, 0.0)
        for value, kind, name in ((0.7, 1, "acceptable"), (1.0, 0, "preferred")):
            lo, hi = _edges(pref, kind, name)
            out[(self.high >= lo) & (self.low <= hi)] = value
        return out


class Listings:
    """The listings of a cell as arrays, sorted by their attributes and cut into runs."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        uid = pdf["uid"].to_numpy(np.int64)
        n = len(uid)
        self.age, self.weight = (Amount(pdf[c].to_numpy(np.float64)) for c in ("age", "weight"))
        nationwide = (pdf["care_region"] == K.NATIONWIDE).fillna(False).to_numpy(bool)
        place, places = pd.factorize(pdf["rescue_location"])  # null: -1
        self.place_of = {x: i for i, x in enumerate(places)}
        spot, spots = pd.factorize(nationwide * np.int64(len(places) + 1) + place + 1)
        self.spot_nationwide, self.spot_place = spots > len(places), spots % (len(places) + 1) - 1
        self.region_codes = Category(spot, len(spots))

        code, lists = pd.factorize(pdf["hashtags"], use_na_sentinel=False)
        tags = [[] if pd.isna(x) else json.loads(x) for x in lists]
        self.no_tags = np.array([len(ts) == 0 for ts in tags], dtype=bool)
        tags = [[t for t in ts if t is not None] for ts in tags]
        self.owner = np.repeat(np.arange(len(tags)), [len(ts) for ts in tags])
        self.tag, self.tags = pd.factorize(np.array([t for ts in tags for t in ts], dtype=object))
        self.tag_codes = Category(code, len(lists))
        self.has: dict[str, np.ndarray] = {}

        code, maps = pd.factorize(pdf["behavior_traits"], use_na_sentinel=False)
        traits = [{} if pd.isna(x) else json.loads(x) for x in maps]
        self.traits = {name: np.array([_number(t.get(name)) for t in traits], dtype=np.float64) for name in {x for t in traits for x in t}}
        self.trait_codes = Category(code, len(maps))

        keys = [pd.factorize(x.values, sort=True)[0] for x in (self.age, self.weight)]
        keys += [x.codes for x in (self.region_codes, self.tag_codes, self.trait_codes)]
        # the column of fewest values first, so that runs are of one kind in as many columns as they can
        order = np.lexsort([uid, *sorted(keys, key=lambda x: -x.max(initial=0))])
        run, starts = np.arange(n) // RUN, np.arange(0, n, RUN)
        self.uid = uid[order]
        for x in (self.region_codes, self.tag_codes, self.trait_codes):
            x.cut(order, run)
        for x in (self.age, self.weight):
            x.cut(order, starts)
        self.first_uid = np.minimum.reduceat(self.uid, starts)

    def __len__(self) -> int:
        return len(self.uid)

    def wanted(self, word: str) -> np.ndarray:
        """Which tag lists have a tag that contains the word or is contained in it."""
        if word not in self.has:
            if (len(self.has) + 1) * len(self.no_tags) > WORD_BYTES:
                self.has.clear()
            good = np.array([word in t or t in word for t in self.tags], dtype=bool)
            hit = np.zeros(len(self.no_tags), dtype=bool)
            if len(self.tag):
                hit[self.owner[good[self.tag]]] = True
            self.has[word] = hit
        return self.has[word]

    def region(self, regions) -> np.ndarray:
        places = [self.place_of[r] for r in _list(regions) if r is not None and r in self.place_of]
        good = self.spot_nationwide.copy()
        for x in places:
            good |= self.spot_place == x
        return good.astype(np.float64)

    def personality(self, words) -> np.ndarray:
        words = _list(words)
        if not words:
            return np.full(len(self.no_tags), 0.5)
        hits = np.zeros(len(self.no_tags))
        for w in words:
            hits += self.wanted(w)
        return np.where(self.no_tags, 0.5, hits / float(len(words)))

    def behavior(self, prefs) -> np.ndarray:
        n = self.trait_codes.n_values
        total, known = np.zeros(n), np.zeros(n)
        for name, pref in _pairs(prefs):
            v = self.traits.get(name)
            if v is None:
                continue
            ideal, near = _field(pref, "ideal", 0), np.zeros(n, dtype=bool)
            for x in _list(_field(pref, "acceptable", 1)):
                near |= v == x
            if _missing(ideal):
                s = np.where(near, 0.7, 1.0)
            else:
                s = np.where(v == ideal, 1.0, np.where(near, 0.7, np.maximum(0.0, 1.0 - np.abs(v - ideal) / 4.0)))
            present = ~np.isnan(v)
            total += np.where(present, s, 0.0)
            known += present
        return np.where(known == 0, 0.5, total / np.maximum(known, 1))

    def slots(self, p) -> list[tuple[float, np.ndarray | float, Callable]]:
        """(weight, bound of each run or of all, scores of given rows) of every slot that the profile has."""
        weights = dict(_pairs(p.weights))
        out = []
        for slot in SLOTS:
            pref = getattr(p, slot)
            if pref is None:
                continue
            w = float(weights.get(K.SLOT_WEIGHT_KEYS[slot], 1))
            if slot in ("age_preference", "size_preference"):
                column = self.age if slot == "age_preference" else self.weight
                out.append((w, column.tops(pref), lambda rows, column=column, pref=pref: column.band(pref, rows)))
                continue
            column, read = {"region": (self.region_codes, self.region), "personality_traits": (self.tag_codes, self.personality),
                            "behavior_preferences": (self.trait_codes, self.behavior)}[slot]
            table = read(pref)
            out.append((w, column.tops(table), lambda rows, column=column, table=table: table[column.codes[rows]]))
        return out

    def best(self, p, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(uid, ``scoring.match_score``) of a profile row's n best listings at or above the threshold; ties go to the smaller uid."""
        slots = self.slots(p)
        size = len(self.first_uid)

        def mean(parts: list, length: int) -> np.ndarray:
            num, den = np.zeros(length), 0.0
            for (w, _, _), part in zip(slots, parts):
                num = num + part * w
                den += w
            return num / den if den > 0 else num

        bound = mean([top for _, top, _ in slots], size)
        if not all(w >= 0 for w, _, _ in slots):  # a negative weight turns a bound round
            bound = np.full(size, np.inf)
        can = np.flatnonzero(bound >= threshold)
        can = can[np.argsort(-bound[can], kind="stable")]
        limit = np.round(bound, TIE_DIGITS)
        uid, score, order = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        step, s = FIRST_RUNS, 0
        while s < len(can) and n > 0:
            some = can[s:s + step]
            s, step = s + step, step * 4
            if len(uid) >= n:  # a closed run counts if it can hold a better row, or an equal one of a smaller uid
                some = some[(limit[some] > order[-1]) | ((limit[some] == order[-1]) & (self.first_uid[some] < uid[-1]))]
                if not len(some):
                    continue
            rows = (some[:, None] * RUN + np.arange(RUN)).ravel()
            rows = rows[rows < len(self)]
            new = mean([part(rows) for _, _, part in slots], len(rows))
            new_order = np.round(new, TIE_DIGITS)
            keep = new >= threshold
            if len(uid) >= n:
                keep &= new_order >= order[-1]
            elif keep.sum() > n:
                keep &= new_order >= -np.partition(-np.where(keep, new_order, -np.inf), n - 1)[n - 1]
            uid, score, order = (np.append(x, y) for x, y in ((uid, self.uid[rows[keep]]), (score, new[keep]), (order, new_order[keep])))
            by = np.lexsort((uid, -order))[:n]
            uid, score, order = uid[by], score[by], order[by]
        return uid, score


# ----------------------------------------------------------------------------------------------
# The grid
# ----------------------------------------------------------------------------------------------
def soft_filter_many(listings: DataFrame, profiles: DataFrame, n: int = 10, threshold: float = K.SCORE_THRESHOLD,
                     available_only: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(profile_id, rank, uid, match_score)``: the n best listings of every profile, as ``scoring.top_matches`` gives
    them for one.  ``profiles`` has the columns of ``PROFILE_SCHEMA``.  A profile without a slot scores 0 everywhere;
    an empty side gives no rows."""
    base = listings.where(open_state()) if available_only else listings
    # lists and maps travel as texts: equal ones are read once in a cell
    items = base.select(F.col("uid").cast("long").alias("uid"), "age", "weight", F.col("care_conditions.region").alias("care_region"),
                        "rescue_location", F.to_json("hashtags").alias("hashtags"), F.to_json("behavior_traits").alias("behavior_traits"))
    people = profiles.select("profile_id", *SLOTS, "weights")
    parts = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("long")
    n_p, n_i = (df.agg(F.count(F.lit(1)).alias("n")).scalar() for df in (people, items))
    rows = F.greatest(one, F.ceil(n_p / block_rows))
    # as many cells as tasks, if that does not make blocks tiny
    columns = F.greatest(one, F.ceil(n_i / (block_rows * LISTING_BLOCKS)), F.least(F.ceil(F.lit(parts) / rows), F.ceil(n_i / LEAST_LISTINGS)))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    people = (people.withColumn("pn", rows).withColumn("ln", columns)
              .withColumn("pb", F.pmod(F.xxhash64("profile_id"), F.col("pn"))).withColumn("lb", every("ln")).drop("pn", "ln"))
    items = (items.withColumn("pn", rows).withColumn("ln", columns)
             .withColumn("lb", F.pmod(F.xxhash64("uid"), F.col("ln"))).withColumn("pb", every("pn")).drop("pn", "ln"))

    def cell(ppdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ppdf) and len(ipdf):
            block = Listings(ipdf)
            for pid, p in zip(ppdf["profile_id"].to_numpy(np.int64), ppdf.itertuples(index=False)):
                uid, score = block.best(p, n, threshold)
                found.append((np.full(len(uid), pid), uid, score))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("profile_id", "uid", "match_score"), zip(*found))})

    best = people.groupBy("pb", "lb").cogroup(items.groupBy("pb", "lb")).applyInPandas(
        cell, "profile_id long, uid long, match_score double")
    w = Window.partitionBy("profile_id").orderBy(F.desc(F.round("match_score", TIE_DIGITS)), F.asc("uid"))
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("profile_id", F.col("rank").cast("long").alias("rank"), "uid", "match_score"))
