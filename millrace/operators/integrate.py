"""Column matching across tables, relationships, safe lookup joins and their validation."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import names as N
from .analysis import NUMERIC
from .profile import TableProfile

KEEP_SCORE, UNIQUE, RESOLVED, MAX_ROWS = 0.55, 0.99, 0.60, 2_000_000
CATEGORY_LIMIT, MISSING_WARNING, UNMATCHED_FAIL = 50, 20.0, 0.10


@dataclass(frozen=True)
class ColumnMatch:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    name_score: float
    type_score: float
    overlap: float
    risky: bool
    score: float

    @property
    def confident(self) -> bool:
        return self.score >= 0.80 and self.name_score >= 0.50 and self.overlap >= 0.70


def keyed(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, column, key): the distinct normalized keys of columns, in long form."""
    rows = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), C.join_key(F.col(f"`{c}`")).alias("key")) for c in columns]
    return df.select(F.inline(F.array(*rows))).filter("key is not null").distinct()


def key_overlaps(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_a, column_a, table_b, column_b, shared, size_a, size_b, overlap) for columns that share keys.

    One self-join of the keys; a key occurs once per column, so its rows are as few as there are columns.
    """
    long = None
    for name, (df, columns) in tables.items():
        part = keyed(df, name, columns)
        long = part if long is None else long.unionByName(part)
    sizes = long.groupBy("table", "column").agg(F.count(F.lit(1)).alias("size"))
    a = long.select(F.col("table").alias("table_a"), F.col("column").alias("column_a"), "key")
    b = long.select(F.col("table").alias("table_b"), F.col("column").alias("column_b"), "key")
    shared = a.join(b, "key").filter("table_a < table_b").groupBy("table_a", "column_a", "table_b", "column_b").agg(F.count(F.lit(1)).alias("shared"))
    sa = sizes.select(F.col("table").alias("table_a"), F.col("column").alias("column_a"), F.col("size").alias("size_a"))
    sb = sizes.select(F.col("table").alias("table_b"), F.col("column").alias("column_b"), F.col("size").alias("size_b"))
    both = shared.join(F.broadcast(sa), ["table_a", "column_a"]).join(F.broadcast(sb), ["table_b", "column_b"])  # a row per column
    overlap = F.when(F.least("size_a", "size_b") >= 2, F.round(F.col("shared") / F.least("size_a", "size_b"), 4)).otherwise(F.lit(0.0))
    return both.select("table_a", "column_a", "table_b", "column_b", "shared", "size_a", "size_b", overlap.alias("overlap"))


#: Entries of a sketch, as a power of two, and standard deviations that a bound leaves for chance.
SKETCH_BITS, DEVIATIONS = 12, 4


def possible_overlaps(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> dict[tuple[str, str, str, str], float]:
    """The most that the keys of each pair of columns (table, column, table, column) can overlap, from a theta sketch per column.

    One scan of each table; what moves is a sketch per column and task, of 32 KB at most.  Small columns are exact.
    """
    used: dict[str, set[str]] = {}
    for a, x, b, y in pairs:
        used.setdefault(a, set()).add(x)
        used.setdefault(b, set()).add(y)
    sketches = None
    for name, columns in used.items():
        rows = [F.struct(F.lit(c).alias("column"), C.join_key(F.col(f"`{c}`")).alias("key")) for c in sorted(columns)]
        keys = tables[name].select(F.inline(F.array(*rows))).filter("key is not null")
        part = keys.groupBy(F.lit(name).alias("table"), "column").agg(F.theta_sketch_agg("key", SKETCH_BITS).alias("sketch"))
        sketches = part if sketches is None else sketches.unionByName(part)
    if sketches is None:
        return {}
    spark = next(iter(tables.values())).sparkSession
    side = lambda n: sketches.select(F.col("table").alias(f"table_{n}"), F.col("column").alias(f"column_{n}"), F.col("sketch").alias(f"sketch_{n}"))
    both = spark.createDataFrame(pairs, "table_a string, column_a string, table_b string, column_b string")
    both = both.join(side("a"), ["table_a", "column_a"]).join(side("b"), ["table_b", "column_b"])
    size = lambda c: F.theta_sketch_estimate(c).cast("double")
    found = both.select(
        "table_a", "column_a", "table_b", "column_b", size("sketch_a").alias("a"), size("sketch_b").alias("b"),
        size(F.theta_intersection("sketch_a", "sketch_b")).alias("shared"), size(F.theta_union("sketch_a", "sketch_b", SKETCH_BITS)).alias("all"),
    )
    out = dict.fromkeys(pairs, 0.0)
    for r in found.collect():  # a row per pair
        share = min(1.0, 2**SKETCH_BITS / max(1.0, r["all"]))  # of all keys that the sketches hold
        held = r["shared"] * share
        chance = 0.0 if share == 1.0 else DEVIATIONS * ((held + 1) ** 0.5 + 1)
        out[r["table_a"], r["column_a"], r["table_b"], r["column_b"]] = min(1.0, (held + chance) / share / max(1.0, min(r["a"], r["b"])))
    return out


def dense_ranges(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Whether a column's keys fill a range of whole numbers, so that they meet others by chance."""
    aggs = []
    for c in columns:
        v = C.join_key(F.col(f"`{c}`")).try_cast("bigint")
        aggs += [F.count_distinct(v).alias(f"d_{c}"), F.min(v).alias(f"a_{c}"), F.max(v).alias(f"b_{c}"), F.count_if(v.isNull() & F.col(f"`{c}`").isNotNull()).alias(f"x_{c}")]
    r = df.agg(*aggs).first()
    return {c: bool(not r[f"x_{c}"] and r[f"d_{c}"] >= 3 and r[f"b_{c}"] - r[f"a_{c}"] + 1 <= 1.5 * r[f"d_{c}"]) for c in columns}


def score_match(name: float, kind: float, overlap: float, risky: bool, both_text: bool) -> float:
    """0.30 name + 0.15 type + 0.55 overlap, less for chance, free text and no overlap at all."""
    if risky and name < 0.5:
        overlap *= 0.3
    if both_text:
        overlap *= 0.5
    score = 0.30 * name + 0.15 * kind + 0.55 * overlap
    return round(score * 0.45 if overlap == 0 else score, 4)


def match_schemas(tables: dict[str, DataFrame], profiles: dict[str, TableProfile], hook=None) -> list[ColumnMatch]:
    """Scored pairs of columns of different tables, best first; candidates are pruned by name and type before any job.

    ``hook(match)`` may return a nudge between -0.25 and 0.15 for undecided pairs.
    """
    pairs = []
    for a, b in combinations(sorted(tables), 2):
        for x, px in profiles[a].columns.items():
            for y, py in profiles[b].columns.items():
                if px.constant or py.constant or N.is_artifact(x) or N.is_artifact(y):
                    continue
                name, kind = N.similarity(x, y), N.type_agreement(px.logical_type, py.logical_type)
                if name >= 0.3 or kind >= 0.5:
                    pairs.append((a, x, b, y, name, kind))
    # Keys move only for pairs that can be kept, by the most that they can overlap.
    text = lambda t, c: profiles[t].columns[c].logical_type == "text"
    most = possible_overlaps(tables, [p[:4] for p in pairs]) if pairs else {}
    nudge = 0.15 if hook else 0.0
    pairs = [p for p in pairs if score_match(p[4], p[5], most[p[:4]], False, text(p[0], p[1]) and text(p[2], p[3])) + nudge >= KEEP_SCORE]
    if not pairs:
        return []
    used = {t: sorted({p[1] for p in pairs if p[0] == t} | {p[3] for p in pairs if p[2] == t}) for t in tables}
    overlaps = {(r["table_a"], r["column_a"], r["table_b"], r["column_b"]): r for r in key_overlaps({t: (tables[t], cs) for t, cs in used.items() if cs}).collect()}
    dense = {t: dense_ranges(tables[t], cs) for t, cs in used.items() if cs}
    out = []
    for a, x, b, y, name, kind in pairs:
        r = overlaps.get((a, x, b, y))
        overlap = r["overlap"] if r else 0.0
        risky = (min(r["size_a"], r["size_b"]) < 8 if r else False) or (dense[a][x] and dense[b][y])
        text = profiles[a].columns[x].logical_type == profiles[b].columns[y].logical_type == "text"
        m = ColumnMatch(a, x, b, y, round(name, 4), kind, overlap, risky, score_match(name, kind, overlap, risky, text))
        if hook and 0.45 <= m.score < 0.80:
            m = ColumnMatch(*[getattr(m, f) for f in list(m.__dataclass_fields__)[:-1]], round(m.score + max(-0.25, min(0.15, hook(m))), 4))
        if m.score >= KEEP_SCORE:
            out.append(m)
    return sorted(out, key=lambda m: -m.score)


def detect_relationships(matches: list[ColumnMatch], profiles: dict[str, TableProfile]) -> list[dict]:
    """The more unique side is the parent; many to many cannot be joined."""
    out = []
    for m in matches:
        ul = profiles[m.left_table].columns[m.left_column].unique_ratio
        ur = profiles[m.right_table].columns[m.right_column].unique_ratio
        left, right = (m.left_table, m.left_column), (m.right_table, m.right_column)
        kind = "one_to_one" if min(ul, ur) >= UNIQUE else "one_to_many" if max(ul, ur) >= UNIQUE else "many_to_many"
        parent, child = (left, right) if ul >= ur else (right, left)
        out.append({"type": kind, "parent": parent, "child": child, "score": m.score, "joinable": kind != "many_to_many" and m.confident})
    return out


def lookup_join(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, parent_name: str) -> DataFrame:
    """Child rows with the parent's columns: never more rows, one parent row per key, clashing names prefixed."""
    key = C.join_key(F.col(f"`{parent_key}`"))
    others = [c for c in parent.columns if c != parent_key]
    new = {c: f"{parent_name}_{c}" if c in child.columns else c for c in others}
    # The least row of each key, as a struct; an aggregate pre-combines where a window would not.
    one = parent.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_p") if others else F.lit(1).alias("_p"))
    joined = child.withColumn("_key", C.join_key(F.col(f"`{child_key}`"))).join(one, "_key", "left")
    return joined.select(*[F.col(f"`{c}`") for c in child.columns], *[F.col(f"_p.`{c}`").alias(new[c]) for c in others])


def key_resolution(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: rows, resolved, unmatched, resolved_share and status of a child's keys in a parent."""
    keys = parent.select(C.join_key(F.col(f"`{parent_key}`")).alias("_key")).filter("_key is not null").distinct().withColumn("_hit", F.lit(1))
    rows = child.select(C.join_key(F.col(f"`{child_key}`")).alias("_key")).join(keys, "_key", "left")
    s = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("_hit").alias("resolved")).withColumn("unmatched", F.col("rows") - F.col("resolved"))
    share = F.round(F.try_divide(F.col("resolved"), "rows"), 4)
    status = F.when(F.col("unmatched") == 0, "passed").when(F.col("unmatched") >= UNMATCHED_FAIL * F.col("rows"), "failed").otherwise("warning")
    return s.select("rows", "resolved", "unmatched", share.alias("resolved_share"), status.alias("status"))


def build_integrated(
    tables: dict[str, DataFrame], relationships: list[dict], profiles: dict[str, TableProfile], max_rows: int | None = None
) -> tuple[dict[str, DataFrame], list[dict]]:
    """The joins that are safe, best first, one per child and pair of tables, and what was skipped and why.

    A lookup join cannot grow, so children may have any number of rows unless ``max_rows`` says otherwise.
    """
    out: dict[str, DataFrame] = {}
    notes: list[dict] = []
    children, pairs = set(), set()
    for r in sorted(relationships, key=lambda r: -r["score"]):
        (pt, pc), (ct, cc) = r["parent"], r["child"]
        skip = None
        if not r["joinable"]:
            skip = f"{r['type']} or not confident"
        elif ct in children or frozenset((pt, ct)) in pairs:
            skip = "already joined"
        elif max_rows is not None and profiles[ct].rows > max_rows:
            skip = f"more than {max_rows} rows"
        else:
            s = key_resolution(tables[ct], tables[pt], cc, pc).first()
            if s["rows"] == 0 or s["resolved"] < RESOLVED * s["rows"]:
                skip = f"only {s['resolved']} of {s['rows']} keys resolve"
        name = f"{ct}_with_{pt}"
        if skip:
            notes.append({"table_name": name, "built": False, "reason": skip})
            continue
        children.add(ct)
        pairs.add(frozenset((pt, ct)))
        out[name] = lookup_join(tables[ct], tables[pt], cc, pc, pt)
        notes.append({"table_name": name, "built": True, "unmatched": s["unmatched"], "expected_rows": s["rows"], "status": s["status"]})
    return out, notes


# -- validation ------------------------------------------------------------------------


def validate(df: DataFrame, p: TableProfile) -> list[dict]:
    """Checks (check, status, detail) over a profile; only invalid values take a job."""
    from .prepare import invalid_values

    checks = [{"check": "rows", "status": "failed" if p.rows == 0 else "passed", "detail": f"{p.rows} rows"}]
    add = lambda c, s, d: checks.append({"check": c, "status": s, "detail": d})
    for name, c in p.columns.items():
        if c.id_candidate or N.looks_like_id(name):
            if c.missing:
                add(f"identifier {name}", "failed", f"{c.missing} missing")
            elif c.distinct < c.rows:
                add(f"identifier {name}", "warning", f"{c.rows - c.distinct} repeated")
            else:
                add(f"identifier {name}", "passed", "unique and complete")
        if c.missing_percent >= MISSING_WARNING:
            add(f"missing {name}", "warning", f"{c.missing_percent} % missing")
        if c.logical_type == "categorical" and c.distinct > CATEGORY_LIMIT:
            add(f"categories {name}", "warning", f"{c.distinct} categories")
        if c.constant:
            add(f"constant {name}", "warning", "one value at most")
    add("duplicate rows", "warning" if p.duplicate_rows else "passed", f"{p.duplicate_rows} duplicate rows")
    for r in invalid_values(df).collect():
        add(f"invalid {r['column']}", "warning", f"{r['n']} values: {r['rule']}")
    return checks


def structural_relevance(p: TableProfile) -> dict[str, str]:
    """Columns that can hardly matter, with the reason."""
    out = {}
    for name, c in p.columns.items():
        reason = (
            "constant" if c.constant
            else "identifier" if c.id_candidate
            else "artifact" if N.is_artifact(name)
            else "mostly missing" if c.missing_percent >= 60
            else "free text" if c.logical_type == "text" and c.unique_ratio > 0.8
            else None
        )
        if reason:
            out[name] = reason
    return out


def detect_report_columns(df: DataFrame, p: TableProfile) -> dict[str, str | None]:
    """The date, metric and group column that a report would use."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and not p.columns[f.name].id_candidate]
    dates = [n for n, c in p.columns.items() if c.logical_type == "datetime"]
    date = next((n for n in dates if N.looks_like_date(n)), dates[0] if dates else None)
    metric = next((n for n in numeric if any(h in n.lower() for h in N.METRIC_HINTS)), None)
    if metric is None and numeric:
        v = df.agg(*[F.var_samp(n).alias(n) for n in numeric]).first()
        metric = max(numeric, key=lambda n: v[n] or 0.0)
    groups = [n for n, c in p.columns.items() if c.logical_type in ("categorical", "text", "boolean") and 2 <= c.distinct <= 50]
    group = next((n for n in groups if any(h in n.lower() for h in N.GROUP_HINTS)), groups[0] if groups else None)
    return {"date": date, "metric": metric, "group": group}


def candidate_targets(p: TableProfile, most: int = 5) -> list[str]:
    named = [n for n in p.columns if n.lower() in N.TARGET_NAMES]
    small = [n for n, c in p.columns.items() if c.logical_type in ("categorical", "boolean") and 2 <= c.distinct <= 10 and n not in named]
    return (named + small)[:most]
