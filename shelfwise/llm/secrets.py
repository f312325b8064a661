"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Pattern matches are candidates. The corpus decides what they are worth: each candidate
value is hashed and counted by distinct owners and distinct repositories. A value that
several owners share, or that stands in many repositories of few owners, is a copied example;
any other value that looks random is reported as live.

Spans come from two built-ins: ``split`` gives the text between matches and
``regexp_extract_all`` the matches, so a running sum of lengths gives every start and
end in code points. Texts never leave the scan; only candidate hashes are shuffled, and
both counts are summed on the map side, so a value in a third of all rows costs its
reducer one row for each map task and owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import shared_table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token"))
#: (kind, pattern, group that holds the secret, least length of that group). The lengths of
#: ``access`` and ``hex`` are in the pattern: a run of one class is cut nowhere else by it.
BASE = [
    ("assign", f"({_NAMES}|{_either_case('api')}_?{_either_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
]
#: Kinds that the method adds; they count only where the corpus shows them live.
ADDED = [
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\t\\r\\n]*", 0, 40),
    ("github", "gh[opsru]_[A-Za-z0-9]{20,}", 0, 24),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", "AIza[A-Za-z0-9_-]{30,}", 0, 34),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("url", "://[A-Za-z0-9_.%-]+:([A-Za-z0-9_.%+!$-]+)@", 1, 8),
]
#: A literal that every match of an added kind or of ``access`` holds: a cheap test before the pattern.
HINT = {"access": "AKIA", "pem": "-----BEGIN ", "github": "gh", "slack": "xox", "google": "AIza", "stripe": "k_live_", "jwt": "eyJ", "url": "://"}
#: Words that mark a value as made up for a manual.
PLACEHOLDER = "(?i)example|sample|placeholder|changeme|change_me|your_|xxxx|dummy|0123456789|123456789|abcdefgh"
#: A value in so many repositories is copied even if one owner holds them all.
COPIED_REPOS = 10
KINDS = [k for k, *_ in BASE + ADDED]
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of one kind, failing ones dropped; empty array if none."""
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )
    no = KINDS.index(kind)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["whole"])
        one = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), part["value"].alias("value"))
        fits = F.coalesce(F.length(part["value"]) >= least, F.lit(False))
        return F.struct(
            F.coalesce(end, state["at"]).alias("at"),
            F.when(fits, F.concat(state["out"], F.array(one))).otherwise(state["out"]).cast(SPAN).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    found = F.aggregate(parts, begin, step, lambda s: s["out"])
    maybe = text.contains(HINT[kind]) if kind in HINT else F.lit(True)
    return F.when(maybe & text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def may_hold(text: Column) -> Column:
    """Does any pattern match? One cheap test for the many texts that hold no candidate."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = F.lit(False)
    for kind, pattern, *_ in BASE + ADDED:
        one = text.rlike(pattern)
        found = found | ((text.contains(HINT[kind]) & one) if kind in HINT else one)
    return found


def candidates(text: Column, kinds: list[tuple] | None = None) -> Column:
    """All spans of ``kinds`` (default: base and added), by start, then kind as listed."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*[spans_of(text, *k) for k in (kinds or BASE + ADDED)]))


def looks_live(value: Column) -> Column:
    """Random-looking: at least six different characters and none of the placeholder words."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 6) & ~value.rlike(PLACEHOLDER)


def ownership(spans: DataFrame, copied_owners: int = 3, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """``(hash, owners, repos, copied, live)`` for each distinct secret of ``spans(hash, owner, repo, looks)``.

    ``copied``: ``copied_owners`` distinct owners or more, or ``copied_repos`` distinct repositories
    or more (a repository of two owners counts for each). ``live``: not copied and a random look.
    Null owners or repositories count as one unnamed owner or repository.
    """
    named = spans.select("hash", "looks", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    each = named.groupBy("hash", "owner", "repo").agg(F.max("looks").alias("looks"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("looks").alias("looks"))
    counted = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("looks").alias("looks"))
    copied = (F.col("owners") >= int(copied_owners)) | (F.col("repos") >= int(copied_repos))
    return counted.select("hash", "owners", "repos", copied.alias("copied"), (F.col("looks") & ~copied).alias("live"))


def _key(spans: Column) -> Column:
    """Tells apart rows of one id whose candidates differ; rows without candidates have an empty key."""
    return F.when(F.size(spans) > 0, F.sha2(F.to_json(spans), 256)).otherwise(F.lit(""))


def _verdicts(rows: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """``(v_id, v_key, live, copied, counts)`` for rows ``(id, owner, repo, key, spans)`` that have candidates.

    ``live`` and ``copied`` hold the secrets' hashes that the corpus shows to be so, ``counts``
    the owners and repositories of each of them.
    """
    each = rows.filter("key <> ''").select("id", "key", "owner", "repo", F.explode("spans").alias("s"))
    each = each.select("id", "key", "owner", "repo", F.sha2("s.value", 256).alias("hash"), looks_live(F.col("s.value")).alias("looks"))
    owned = shared_table(ownership(each, copied_owners, copied_repos).filter("live OR copied"))
    owned = owned.select(F.col("hash").alias("hash_"), "owners", "repos", "live")
    mine = each.select("id", "key", "hash").join(owned, F.col("hash") == F.col("hash_"))
    return mine.groupBy(F.col("id").alias("v_id"), F.col("key").alias("v_key")).agg(
        F.collect_set(F.when(F.col("live"), F.col("hash"))).alias("live"),
        F.collect_set(F.when(~F.col("live"), F.col("hash"))).alias("copied"),
        F.collect_set(F.struct("hash", "owners", "repos")).alias("counts"),
    )


def _rows(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    found = df.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        candidates(F.col(text_col)).alias("spans"),
    )
    return found.withColumn("key", _key(F.col("spans")))


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    copied_owners: int = 3,
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """``(id_col, base, spans, live, copied, counts)``, one row for each input row.

    ``base``: spans of the base kinds. ``spans``: these and the spans of the added kinds
    whose secret the corpus shows live. Each span has start, end (code points, end
    exclusive), kind and the secret's value; ``live`` and ``copied`` are the SHA-256 hashes of
    the row's secrets that few hold or that are copied (see :func:`ownership`), and ``counts``
    their ``(hash, owners, repos)``. Null text
    counts as empty, repeated rows come back repeated, an empty table gives no rows.
    """
    rows = shared_table(_rows(df, id_col, text_col, owner_col, repo_col))
    verdicts = _verdicts(rows, copied_owners, copied_repos)
    none, no_counts = F.array().cast("array<string>"), F.array().cast(verdicts.schema["counts"].dataType)
    with_some = rows.filter("key <> ''").join(verdicts, F.col("id").eqNullSafe(F.col("v_id")) & (F.col("key") == F.col("v_key")), "left")
    with_some = with_some.select("id", "spans", F.coalesce("live", none).alias("live"), F.coalesce("copied", none).alias("copied"), F.coalesce("counts", no_counts).alias("counts"))
    all_rows = with_some.unionByName(rows.filter("key = ''").select("id", "spans", none.alias("live"), none.alias("copied"), no_counts.alias("counts")))
    is_base = lambda s: s["kind_no"] < len(BASE)
    return all_rows.select(
        F.col("id").alias(id_col),
        F.filter("spans", is_base).alias("base"),
        F.filter("spans", lambda s: is_base(s) | F.array_contains(F.col("live"), F.sha2(s["value"], 256))).alias("spans"),
        "live",
        "copied",
        "counts",
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    copied_owners: int = 3,
    mask: str = "[secret]",
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """``df`` with every span of a live secret replaced by ``mask``; all rows and columns stay.

    Overlapping spans are masked once. Copied examples and rows without a live secret stay
    as they are. Only rows that hold candidates are shuffled; other texts pass straight through.
    """
    maybe = may_hold(F.col(text_col))
    rows = shared_table(_rows(df.filter(maybe), id_col, text_col, owner_col, repo_col))
    verdicts = shared_table(_verdicts(rows, copied_owners, copied_repos).filter("size(live) > 0"))
    packed = df.filter(maybe).select(F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    packed = packed.withColumn("spans", candidates(F.col("row")[text_col]))
    packed = packed.withColumn("key", _key(F.col("spans")))
    clean = df.filter(~maybe)
    joined = packed.join(verdicts, F.col("row")[id_col].eqNullSafe(F.col("v_id")) & (F.col("key") == F.col("v_key")), "left")
    live = F.filter("spans", lambda s: F.coalesce(F.array_contains(F.col("live"), F.sha2(s["value"], 256)), F.lit(False)))
    text = F.col("row")[text_col]

    def step(state: Column, s: Column) -> Column:
        kept = F.when(s["start"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask)))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.concat(state["out"], F.coalesce(kept, F.lit(""))).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(live, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    new = F.when(F.size(live) > 0, masked).otherwise(text)
    changed = joined.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
    return clean.unionByName(changed)
