"""Privacy, integrity and permission audits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossweave.functions.time import epoch_micros
from glossweave.operators.mondrian import narrow_groups
from glossweave.plans.scale import HOT_ROWS, mark_chunks
from glossweave.session import stored

# event type -> days to keep; a type that is not listed has no limit.
RETENTION_DAYS = {"view": 7, "click": 14, "error": 3, "purchase": 365}

# (rule, text that must occur, pattern, replacement), applied in this order.
REDACTIONS = [
    (
        "token",
        "",
        r'(?i)(?:token|secret|password|api_?key) ?[=:] ?"?[A-Za-z0-9_-]{16,}"?',
        "[TOKEN]",
    ),
    ("email", "@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    ("ip", ".", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "[IP]"),
    ("phone", "+", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]"),
]

ALLOWED_PERMISSIONS = ["activeTab", "storage", "offscreen", "scripting"]


def _ttl(policies: Mapping[str, int], col: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in policies.items() for x in kv])
    return F.try_element_at(table, F.col(col))


def _expired(policies: Mapping[str, int], as_of: str | dt.date, col: str, ts: str) -> Column:
    """True once a whole ttl in days has passed between the row's date and ``as_of``."""
    ttl = _ttl(policies, col)
    day = F.lit(str(as_of)).cast("date")
    return ttl.isNotNull() & (F.to_date(ts) < F.date_sub(day, ttl))


def apply_retention(
    df: DataFrame,
    policies: Mapping[str, int],
    as_of: str | dt.date,
    col: str = "event_type",
    ts: str = "ts",
) -> DataFrame:
    """Rows still inside their time to live at ``as_of``."""
    return df.filter(~F.coalesce(_expired(policies, as_of, col, ts), F.lit(False)))


def retention_report(
    df: DataFrame,
    policies: Mapping[str, int],
    as_of: str | dt.date,
    col: str = "event_type",
    ts: str = "ts",
) -> DataFrame:
    """Per class (col, ttl_days, n_kept, n_expired, oldest)."""
    expired = F.coalesce(_expired(policies, as_of, col, ts), F.lit(False))
    return (
        df.groupBy(col)
        .agg(
            F.count_if(~expired).alias("n_kept"),
            F.count_if(expired).alias("n_expired"),
            F.min(ts).alias("oldest"),
        )
        .withColumn("ttl_days", _ttl(policies, col))
    )


def apply_consent(
    events: DataFrame,
    consent: DataFrame,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Events whose user had granted consent at event time (as-of join, consent at the same instant counts).

    ``consent`` is (user_id, state, ts).  Both are put in one time line per user;
    a user with very many rows is cut into time chunks, and the last state before
    each chunk is carried in from per-chunk maxima.  A null state changes nothing.
    """
    cols = events.columns
    line = events.select("user_id", "ts", F.lit(1).alias("_src"), F.struct(*cols).alias("_e")).unionByName(
        consent.select("user_id", "ts", F.lit(0).alias("_src"), F.col("state").alias("_state")),
        allowMissingColumns=True,
    )
    marked = mark_chunks(line, ["user_id"], [F.col("ts")], limit)
    parts = ["user_id"] if marked is None else ["user_id", "_chunk"]
    # Of several consent rows at one instant the revocation, sorting last, decides.
    ordered = Window.partitionBy(*parts).orderBy("ts", "_src", F.col("_state").asc_nulls_last())
    own = F.last("_state", ignorenulls=True).over(ordered)
    if marked is None:
        return (
            line.withColumn("_own", own)
            .filter((F.col("_src") == 1) & (F.col("_own") == "granted"))
            .select("_e.*")
        )
    known = (F.col("_src") == 0) & F.col("_state").isNotNull()
    lasts = (
        marked.filter("_hot")
        .groupBy("user_id", "_chunk")
        .agg(F.max(F.when(known, F.struct("ts", "_state"))).alias("_m"))
    )
    earlier = Window.partitionBy("user_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        "user_id", "_chunk", F.last(F.col("_m._state"), ignorenulls=True).over(earlier).alias("_before")
    )
    return (
        marked.withColumn("_own", own)
        .filter(F.col("_src") == 1)
        .join(carried, ["user_id", "_chunk"], "left")
        .filter(F.coalesce("_own", "_before") == "granted")
        .select("_e.*")
    )


def anonymize(
    df: DataFrame,
    text: str = "text",
    ids: Sequence[str] = (),
    salt: str = "",
    rules: Sequence[tuple[str, str, str, str]] = REDACTIONS,
) -> DataFrame:
    """Redact patterns in ``text``, replace ``ids`` by salted hashes, add ``n_<rule>`` hits.

    The hits of a rule are counted in the text the earlier rules left.  A rule's
    pattern is tried only where the text that must occur does.
    """
    for name, needle, pattern, replacement in rules:
        replaced = F.regexp_replace(text, pattern, replacement)
        hits = F.regexp_count(F.col(text), F.lit(pattern))
        may_hit = F.contains(F.col(text), F.lit(needle))
        df = df.withColumn(f"n_{name}", F.when(may_hit, hits).otherwise(0)).withColumn(
            text, F.when(F.col(f"n_{name}") > 0, replaced).otherwise(F.col(text))
        )
    for col in ids:
        df = df.withColumn(col, F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col(col).cast("string")), 256))
    return df


def k_anonymity(df: DataFrame, quasi: Sequence[str], k: int) -> DataFrame:
    """Quasi-identifier groups with fewer than ``k`` rows."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k)


def anonymize_groups(df: DataFrame, quasi: Sequence[str], k: int = 10) -> DataFrame:
    """``df`` made k-anonymous: each numeric quasi-identifier q becomes a range q_low to q_high.

    Mondrian partitioning (LeFevre et al. 2006).  All rows start as one group.  A group is
    cut in two where the ranges of both halves are narrowest (as a share of the whole
    table's, weighted by rows), of the cuts that keep ``k`` rows on both sides and leave
    room for as many groups as before; a group without a cut is final.  Large groups are
    cut by trees found on a sample, checked by exact counts (``narrow_groups``), so a
    group that holds all rows is never in one task.  A null is a value below all others
    and gives a null lower end.  Every row comes out once, with its other columns and
    ``group_size``; rows with equal quasi-identifiers share a group.  A table of fewer
    than ``k`` rows is one group without ranges.
    """
    if k < 1:
        raise ValueError("k must be positive")
    names = [f"_q{i}" for i in range(len(quasi))]
    value = {n: F.coalesce(F.col(q).cast("double"), F.lit(float("-inf"))) for n, q in zip(names, quasi)}
    whole = df.select(*[v.alias(n) for n, v in value.items()])
    span = whole.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(F.when(F.col(n) > float("-inf"), F.col(n))).alias(f"{n}_{e}") for n in names for f, e in ((F.min, "lo"), (F.max, "hi"))],
    ).first()
    widths = {n: ((span[f"{n}_hi"] or 0.0) - (span[f"{n}_lo"] or 0.0)) or 1.0 for n in names}
    # one row per distinct tuple, with its weight
    tuples = stored(whole.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "mondrian")
    groups = stored(narrow_groups(tuples, names, [widths[n] for n in names], k), "groups")
    ends = [
        F.when(F.col(f"{n}_{e}") > float("-inf"), F.col(f"{n}_{e}")).alias(f"{q}_{e2}")
        for n, q in zip(names, quasi) for e, e2 in (("lo", "low"), ("hi", "high"))
    ]
    if (span["n"] or 0) < k:
        ends = [F.lit(None).cast("double").alias(f"{q}_{e}") for q in quasi for e in ("low", "high")]
    ranges = groups.select(*names, F.col("_size").alias("group_size"), *ends)
    keyed = df.withColumns(value).join(ranges, names)
    return keyed.drop(*names, *quasi)


def information_loss(anonymous: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """One row: rows, smallest_group, loss (mean width of the ranges as a share of the whole range).

    Zero if nothing was widened, one if every row got the whole range; the normalised
    certainty penalty.  A null range counts as the whole.
    """
    spans = anonymous.agg(*[F.max(f"{q}_high") - F.min(f"{q}_low") for q in quasi]).first()
    share = [
        F.coalesce((F.col(f"{q}_high") - F.col(f"{q}_low")) / F.lit(width) if width else F.lit(0.0), F.lit(1.0))
        for q, width in zip(quasi, spans)
    ]
    mean = sum(share[1:], share[0]) / len(quasi)
    return anonymous.agg(
        F.count(F.lit(1)).alias("rows"), F.min("group_size").alias("smallest_group"), F.avg(mean).alias("loss")
    )


def protect_columns(df: DataFrame, cols: Sequence[str], key: Column) -> DataFrame:
    """Encrypt columns with AES-GCM; the value is base64 text, null stays null.

    Each value gets a random nonce, so equal inputs differ and runs differ.  Pass
    the key as a column (16, 24 or 32 bytes), for example from a secret in the
    session configuration, so that it does not appear in the code.
    """
    for c in cols:
        df = df.withColumn(
            c, F.base64(F.aes_encrypt(F.encode(F.col(c).cast("string"), "UTF-8"), key, F.lit("GCM")))
        )
    return df


def reveal_columns(df: DataFrame, cols: Sequence[str], key: Column) -> DataFrame:
    """Decrypt columns written by ``protect_columns``; a wrong key or changed value fails."""
    for c in cols:
        df = df.withColumn(c, F.decode(F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")), "UTF-8"))
    return df


def _tagged(kind: str, values: Column, name: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias(name)))


def permission_audit(
    manifests: DataFrame, allowed: Sequence[str] = ALLOWED_PERMISSIONS, key: str = "name"
) -> DataFrame:
    """Permissions outside the allow-list: (key, kind, permission).

    ``kind`` keeps required, optional and host permissions apart.
    """
    listed = F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
    kinds = [
        ("required", "permissions"),
        ("optional", "optional_permissions"),
        ("host", "host_permissions"),
    ]
    empty = F.array().cast("array<string>")
    extra = F.flatten(
        F.array(
            *[
                _tagged(kind, F.array_except(F.coalesce(F.col(c), empty), listed), "permission")
                for kind, c in kinds
            ]
        )
    )
    return manifests.select(key, F.explode(extra).alias("_x")).select(key, "_x.kind", "_x.permission")


def manifest_references(manifests: DataFrame, key: str = "name") -> DataFrame:
    """Every path a manifest refers to, once: (key, kind, path)."""
    empty = F.array().cast("array<string>")

    def one(col: str) -> Column:
        return F.array(F.col(col))

    def many(col: Column) -> Column:
        return F.flatten(F.filter(F.coalesce(col, F.array(empty)), lambda a: a.isNotNull()))

    sources = [
        ("background", one("background.service_worker")),
        ("script", many(F.col("content_scripts.js"))),
        ("style", many(F.col("content_scripts.css"))),
        ("resource", many(F.col("web_accessible_resources.resources"))),
        ("popup", one("action.default_popup")),
        ("icon", F.map_values("action.default_icon")),
        ("icon", F.map_values("icons")),
        ("options", one("options_page")),
        ("sandbox", F.col("sandbox.pages")),
    ]
    refs = F.flatten(
        F.array(*[_tagged(kind, F.coalesce(paths, empty), "path") for kind, paths in sources])
    )
    return (
        manifests.select(key, F.explode(F.array_distinct(refs)).alias("_x"))
        .select(key, "_x.kind", "_x.path")
        .filter(F.col("path").isNotNull())
    )


def manifest_path_audit(manifests: DataFrame, files: DataFrame, key: str = "name") -> DataFrame:
    """Referenced paths with no file: (key, kind, path); ``*`` in a path matches any text.

    Plain paths meet files by equality.  A glob meets the files below the folder
    in front of its first ``*``, again by equality, and only then by pattern, and
    each distinct glob is looked up once.
    """
    refs = manifest_references(manifests, key)
    paths = files.select("path").distinct()
    plain = refs.filter(~F.contains("path", F.lit("*")))
    globs = refs.filter(F.contains("path", F.lit("*")))
    missing_plain = plain.join(paths, "path", "left_anti").select(key, "kind", "path")

    folder = F.regexp_extract("path", r"^([^*]*/)?[^/*]*\*", 1)
    wanted = globs.select("path").distinct().select(F.col("path").alias("glob"), folder.alias("folder"))
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))),
    )
    placed = paths.select("path", F.explode(above).alias("folder"))
    # A glob that is a folder and one final star matches whatever lies below the folder.
    simple = wanted.filter(F.col("glob") == F.concat("folder", F.lit("*"))).join(
        placed.select("folder").distinct(), "folder", "left_semi"
    )
    pattern = F.concat(
        F.lit("^"),
        F.regexp_replace(F.regexp_replace("glob", r"([.\\+?^$()\[\]{}|])", r"\\$1"), r"\*", ".*"),
        F.lit("$"),
    )
    other = (
        placed.join(
            wanted.filter(F.col("glob") != F.concat("folder", F.lit("*"))).withColumn("_re", pattern),
            "folder",
        )
        .filter(F.regexp_like("path", F.col("_re")))
        .select("glob")
        .distinct()
    )
    found = simple.select(F.col("glob").alias("path")).unionByName(other.select(F.col("glob").alias("path")))
    missing_globs = globs.join(found, "path", "left_anti").select(key, "kind", "path")
    return missing_plain.unionByName(missing_globs)


def integrity_audit(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Compare (path, content) with (path, sha256): (path, status, expected, actual).

    Status is matched, changed, missing (listed, no file) or extra (file, not listed).
    A file without content is there; it matches only a listing without a checksum.
    """
    have = files.select("path", F.sha2("content", 256).alias("actual"), F.lit(True).alias("_file"))
    want = checksums.select("path", F.col("sha256").alias("expected"), F.lit(True).alias("_listed"))
    status = (
        F.when(F.col("_file").isNull(), "missing")
        .when(F.col("_listed").isNull(), "extra")
        .when(F.col("actual").eqNullSafe(F.col("expected")), "matched")
        .otherwise("changed")
    )
    return have.join(want, "path", "full_outer").select("path", status.alias("status"), "expected", "actual")
