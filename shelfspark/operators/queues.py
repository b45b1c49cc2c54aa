"""Work queues: first-seen dedupe, pending items, log merge, slots, progress.

Joins are plain equi joins without hints, so that Spark picks the strategy from
sizes it knows and splits skewed sides at run time; "first" and "latest" rows go
through ``row_number() <= n``, which Spark limits per key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import urls as U
from shelfspark.functions.core import collapse_ws, split_nonblank
from shelfspark.plans import chunked
from shelfspark.profiles import DAILY_SLOTS, SECTION_SLUGS, UrlProfile


# ---- order and dedupe ------------------------------------------------------
def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rn"
) -> DataFrame:
    """First ``n`` rows of every key in the given order, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def dedupe_first(
    df: DataFrame, key: Column | str, order: Sequence[Column | str], out: str = "key"
) -> DataFrame:
    """First row of every non-blank key; ``out`` holds the (canonical) key."""
    keyed = df.withColumn(out, F.trim(F.col(key) if isinstance(key, str) else key))
    keyed = keyed.filter(F.length(out) > 0)
    return top_n_per_key(keyed, [out], order, 1, "_rn").drop("_rn")


def kept_counts(df: DataFrame, key: Column) -> DataFrame:
    """(original, kept, removed) of a dedupe on ``key``; blank keys are removed."""
    k = F.nullif(F.trim(key), F.lit(""))
    per_key = df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("original"), F.count("k").alias("kept")
    )
    return totals.withColumn("removed", F.col("original") - F.col("kept"))


def union_sources(
    sources: Sequence[DataFrame], key: str, order: Sequence[str]
) -> DataFrame:
    """Union of several extractors; earlier sources win for the same key."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    merged = tagged[0]
    for extra in tagged[1:]:
        merged = merged.unionByName(extra)
    return dedupe_first(merged, key, ["source_no", *order], out=key)


def restore_order(
    df: DataFrame, order: DataFrame, key: str = "url", position: str = "ord"
) -> DataFrame:
    """Attach input positions (last one per key wins) and sort; unknown keys have none and come last."""
    last = order.groupBy(key).agg(F.max(position).cast("bigint").alias(position))
    return df.join(last, key, "left").orderBy(F.col(position).asc_nulls_last())


def limit_first(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in input order; 0 keeps all."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def first_valid(df: DataFrame, valid: Column, order: Sequence[str]) -> DataFrame:
    """The first row that passes (no row when none does)."""
    return df.filter(valid).orderBy(*order).limit(1)


def latest_per_key(
    manifest: DataFrame,
    key: str = "key",
    mtime: str = "mtime",
    path: str = "path",
    seen: Column | None = None,
    any_key: str | None = None,
) -> DataFrame:
    """Newest artifact per key, unseen ones first.

    With ``any_key`` a one-row fallback for that key is added: the newest
    artifact of all when the key itself has none.
    """
    is_new = F.lit(1) if seen is None else F.when(seen, 0).otherwise(1)
    ranked = manifest.withColumn("_new", is_new)
    order = [F.desc("_new"), F.desc(mtime), F.asc(path)]
    best = top_n_per_key(ranked, [key], order, 1, "_rn").drop("_rn", "_new")
    if any_key is None:
        return best
    pick = manifest.withColumn("_same", F.when(F.col(key) == any_key, 1).otherwise(0))
    return pick.orderBy(F.desc("_same"), F.desc(mtime), F.asc(path)).limit(1).drop("_same")


def filter_branches(
    df: DataFrame,
    url: str = "branch_url",
    up_flag: str = "is_up_link",
    order: Sequence[str] = ("ord",),
    include_up_links: bool = False,
) -> DataFrame:
    """Non-blank, first-seen branch URLs; up-links only when asked for."""
    keep = df
    if not include_up_links:
        keep = keep.filter(~F.coalesce(F.col(up_flag), F.lit(False)))
    return dedupe_first(keep, url, list(order), out=url)


# ---- joins -----------------------------------------------------------------
def slug_dimension(spark) -> DataFrame:
    rows = [(name, slug) for name, slug in SECTION_SLUGS.items()]
    return spark.createDataFrame(rows, "name string, slug string")


def lookup_slug(
    df: DataFrame,
    name: str,
    dim: dict[str, str] | DataFrame | None = None,
    profile: UrlProfile = UrlProfile(),
) -> DataFrame:
    """Slug of a section name: dimension hit, slug-like value, or a guess.

    The dimension is joined without a hint: its size decides how.
    """
    if dim is None:
        dim = SECTION_SLUGS
    if isinstance(dim, dict):
        table = df.sparkSession.createDataFrame(list(dim.items()), "_name string, _slug string")
    else:
        table = dim.select(F.col("name").alias("_name"), F.col("slug").alias("_slug"))
    wanted = F.lower(collapse_ws(name))
    guess = F.regexp_replace(
        F.regexp_replace(F.replace(wanted, F.lit("&"), F.lit("and")), "[^a-z0-9]+", "-"),
        "^-+|-+$",
        "",
    )
    out = df.withColumn("_wanted", wanted).join(
        table, F.col("_wanted") == F.col("_name"), "left"
    )
    slug = (
        F.when(F.col("_slug").isNotNull(), F.col("_slug"))
        .when(F.col("_wanted").rlike("^[a-z0-9-]+$"), F.col("_wanted"))
        .when(guess != "", guess)
        .otherwise(F.lit(profile.default_section))
    )
    out = out.withColumn("slug", slug).withColumn("known", F.col("_slug").isNotNull())
    start = F.concat(
        F.lit(f"https://{profile.domain}{profile.listing_prefix}/"),
        F.col("slug"),
        F.replace(F.lit(profile.start_ref), F.lit("{section}"), F.col("slug")),
    )
    return out.withColumn("start_url", start).drop("_wanted", "_name", "_slug")


def pending(
    items: DataFrame,
    done: DataFrame,
    skipped: DataFrame,
    key: str = "url",
    branch: Sequence[str] = (),
    order: Sequence[str] = ("ord",),
) -> DataFrame:
    """Items (unique per branch, first kept) that are neither done nor skipped.

    Keys of done and skipped may be repeated.
    """
    unique = top_n_per_key(items, [*branch, key], list(order), 1, "_rn").drop("_rn")
    return unique.join(done.select(key).unionByName(skipped.select(key)), key, "left_anti")


def recover_skipped(
    skipped: DataFrame,
    artifacts: DataFrame,
    queue: DataFrame,
    cursor: DataFrame | None = None,
    key: str = "url",
    profile: UrlProfile | None = None,
    item: str = "item_key",
    position: str = "pos",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recovered, still skipped, cursor) given the artifacts that are ready.

    ``cursor`` is a one-row table (cursor bigint); the new one is lowered to the
    first queue position of a recovered url. Urls without an item key stay.
    """
    if profile is not None:
        skipped = skipped.withColumn(item, U.key_from_url(key, profile))
    keyed = skipped.withColumn(item, F.nullif(F.col(item).cast("string"), F.lit("")))
    ready = artifacts.select(F.col(item).cast("string").alias(item)).distinct()
    recovered = keyed.join(ready, item, "left_semi").select(*skipped.columns)
    remaining = keyed.join(ready, item, "left_anti").select(*skipped.columns)
    first = queue.groupBy(key).agg(F.min(position).alias(position))
    rewind = recovered.join(first, key).agg(F.min(position).alias("rewind"))
    if cursor is None:
        return recovered, remaining, rewind
    # Both sides are single rows by construction (aggregate without keys).
    now = cursor.agg(F.min("cursor").alias("cursor")).withColumn("_one", F.lit(1))
    moved = now.join(F.broadcast(rewind.withColumn("_one", F.lit(1))), "_one").select(
        F.least("cursor", F.coalesce("rewind", "cursor")).cast("bigint").alias("cursor")
    )
    return recovered, remaining, moved


def merge_log(state: DataFrame, log: DataFrame, key: str = "url") -> DataFrame:
    """Keys of the state plus those of the log it lacks; ``added`` marks new ones."""
    old = state.select(key).distinct()
    logged = log.select(key).filter(F.length(F.col(key).cast("string")) > 0).distinct()
    new = logged.join(old, key, "left_anti")
    return old.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


def lookup_with_fallback(
    keys: DataFrame,
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    values: Sequence[str],
    fallback: str = "first",
) -> DataFrame:
    """Row of each key (trimmed, upper case, first match).

    ``fallback`` for keys without a row: ``first`` = the first row of all,
    ``null`` = no values, ``stub`` = empty values.
    """
    norm = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    named = rows.withColumn("_k", norm(key)).filter(F.col("_k") != "")
    best = top_n_per_key(named, ["_k"], list(order), 1, "_rn").select(
        "_k", *[F.col(v).alias(f"_m_{v}") for v in values], F.lit(True).alias("matched")
    )
    out = keys.withColumn("_k", norm(key)).join(best, "_k", "left").drop("_k")
    out = out.withColumn("matched", F.coalesce("matched", F.lit(False)))
    if fallback == "first":
        # One row by construction: an aggregate without grouping keys.
        first = rows.agg(
            F.min_by(F.struct(*[F.col(v).alias(f"_d_{v}") for v in values]),
                     F.struct(*order)).alias("_d")
        ).withColumn("_one", F.lit(1))
        out = out.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one", "left")
        filled = [
            F.when(F.col("matched"), F.col(f"_m_{v}")).otherwise(F.col(f"_d._d_{v}")).alias(v)
            for v in values
        ]
    elif fallback == "stub":
        filled = [
            F.when(F.col("matched"), F.col(f"_m_{v}").cast("string"))
            .otherwise(F.lit("")).alias(v)
            for v in values
        ]
    else:
        filled = [F.col(f"_m_{v}").alias(v) for v in values]
    return out.select(*keys.columns, "matched", *filled)


# ---- slots -----------------------------------------------------------------
def slot_minutes(slots: Sequence[str] = DAILY_SLOTS) -> list[int]:
    """Sorted unique minutes since midnight of an HH:MM list (job configuration)."""
    out = set()
    for token in (s.strip() for s in slots):
        hour, sep, minute = token.partition(":")
        if not sep or not (0 <= int(hour) <= 23 and 0 <= int(minute) <= 59):
            raise ValueError(f"bad slot {token!r}")
        out.add(int(hour) * 60 + int(minute))
    if not out:
        raise ValueError("at least one slot is required")
    return sorted(out)


def _at_minute(ts: Column, day_offset: Column, minute: Column) -> Column:
    """Midnight of the timestamp's day + days + minutes, in the column's own type."""
    return F.make_dt_interval(day_offset, F.lit(0), minute) + ts


def _midnight(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def next_slot(df: DataFrame, ts: str, slots: Sequence[str] = DAILY_SLOTS) -> DataFrame:
    """Earliest daily slot strictly after ``ts``, else tomorrow's first one.

    The daily slots are job configuration, so the as-of match is a filter over a
    literal array: no join, no shuffle.
    """
    minutes = F.array(*[F.lit(m) for m in slot_minutes(slots)])
    now = F.col(ts).cast("timestamp_ntz")
    midnight = _midnight(now)
    into_day = F.hour(now) * 60 + F.minute(now)
    # A slot equals "now" only on the exact minute; either way it is not later.
    hit = F.array_min(F.filter(minutes, lambda m: m > into_day))
    slot = F.when(
        hit.isNotNull(), _at_minute(midnight, F.lit(0), hit)
    ).otherwise(_at_minute(midnight, F.lit(1), F.array_min(minutes)))
    return df.withColumn("next_slot", slot)


def deadlines(
    df: DataFrame,
    ts: str,
    slot: str = "next_slot",
    wake_minutes: int = 30,
    cutoff_minutes: int = 10,
) -> DataFrame:
    """Wake-up and cut-off times of a slot, and the phase ``ts`` falls into."""
    back = lambda m: F.col(slot) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    out = df.withColumn("wake_at", back(wake_minutes)).withColumn(
        "cutoff_at", back(max(1, cutoff_minutes))
    )
    now = F.col(ts).cast("timestamp_ntz")
    phase = (
        F.when(now < F.col("wake_at"), "sleep")
        .when(now < F.col("cutoff_at"), "prepare")
        .when(now < F.col(slot), "wait")
        .otherwise("missed")
    )
    return out.withColumn("phase", phase)


def slot_calendar(
    schedules: DataFrame, slots: str, first_day: str, last_day: str
) -> tuple[DataFrame, DataFrame]:
    """(calendar, rejects) of schedule rows that list ``HH:MM`` slots as text.

    A schedule with any bad token or no token is rejected whole.
    """
    tokens = split_nonblank(F.coalesce(F.col(slots), F.lit("")), ",")

    def minute_of(token: Column) -> Column:
        h = F.regexp_extract(token, r"^\s*([0-9]+)\s*:\s*([0-9]+)\s*$", 1).try_cast("int")
        m = F.regexp_extract(token, r"^\s*([0-9]+)\s*:\s*([0-9]+)\s*$", 2).try_cast("int")
        return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)

    parsed = schedules.withColumn("_minutes", F.transform(tokens, minute_of))
    good = (F.size("_minutes") > 0) & ~F.exists("_minutes", lambda m: m.isNull())
    days = F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    calendar = (
        parsed.filter(good)
        .withColumn("slot_minute", F.explode(F.array_sort(F.array_distinct("_minutes"))))
        .withColumn("slot_day", F.explode(days))
        .withColumn(
            "slot_at",
            _at_minute(F.col("slot_day").cast("timestamp_ntz"), F.lit(0), F.col("slot_minute")),
        )
        .drop("_minutes")
    )
    return calendar, parsed.filter(~good).drop("_minutes")


def assign_slots(
    queue: DataFrame,
    position: str,
    start: str,
    slots: Sequence[str] = DAILY_SLOTS,
    chunk_width: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """i-th queue item -> i-th slot after ``start``.

    Chunks of positions lie between quantiles, or have ``chunk_width`` where positions
    are known to be dense.

    Ranks come from the chunked rank; since the daily slots repeat, slot i is
    arithmetic on the rank and no calendar has to be joined.
    """
    minutes = slot_minutes(slots)
    ranked = chunked.running(
        queue, list(keys), [position],
        chunked.by_id(position, chunk_width) if chunk_width else chunked.by_quantiles(queue, position),
        rank="slot_no",
    )
    begin = F.lit(start).cast("timestamp_ntz")
    into_day = F.hour(begin) * 60 + F.minute(begin)
    gone = sum((F.when(into_day >= m, 1).otherwise(0) for m in minutes), F.lit(0))
    nth = F.col("slot_no") - 1 + gone
    of_day = F.array(*[F.lit(m) for m in minutes])
    minute = F.element_at(of_day, (nth % len(minutes) + 1).cast("int"))
    day = F.floor(nth / len(minutes)).cast("int")
    return ranked.withColumn("slot_at", _at_minute(_midnight(begin), day, minute))


def assign_calendar_slots(
    queue: DataFrame, position: str, calendar: DataFrame, start: str, keys: Sequence[str] = (),
    slot: str = "slot_at",
) -> DataFrame:
    """i-th queue item -> i-th slot of a calendar table after ``start``, per key.

    Both sides are ranked in chunks and joined on (key, rank). Items beyond the
    calendar's last slot have no slot.
    """
    later = calendar.filter(F.col(slot) > F.lit(start).cast("timestamp_ntz")).select(*keys, slot)
    slots = chunked.running(later, list(keys), [slot], chunked.by_quantiles(later, slot), rank="slot_no")
    ranked = chunked.running(
        queue, list(keys), [position], chunked.by_quantiles(queue, position), rank="slot_no"
    )
    return ranked.join(slots, [*keys, "slot_no"], "left")


def next_calendar_slot(
    requests: DataFrame, at: str, calendar: DataFrame, key: str, slot: str = "slot_at", out: str = "next_slot"
) -> DataFrame:
    """First slot of the calendar strictly after ``at``, per key; null after the last one.

    Requests meet the slots of their own day, which are few, and else the first slot of
    the next day that has one: two equi joins on (key, day).
    """
    day = F.to_date(F.col(slot)).alias("_day")
    days = calendar.select(key, day, F.col(slot).alias("_s")).groupBy(key, "_day").agg(
        F.array_sort(F.collect_set("_s")).alias("_slots")
    )
    asked = requests.withColumn("_day", F.to_date(F.col(at)))
    every = days.select(key, "_day").union(asked.select(key, "_day")).distinct().join(days, [key, "_day"], "left")
    later = Window.partitionBy(key).orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    every = every.withColumn("_after", F.min(F.element_at("_slots", F.lit(1))).over(later))
    today = F.try_element_at(F.filter("_slots", lambda s: s > F.col(at)), F.lit(1))
    return asked.join(every, [key, "_day"], "left").withColumn(out, F.coalesce(today, F.col("_after"))).drop(
        "_day", "_slots", "_after"
    )


# ---- status aggregates -----------------------------------------------------
def error_by_key(
    events: DataFrame,
    key: str,
    order: Sequence[str],
    is_error: Column,
    is_success: Column,
    message: str,
) -> DataFrame:
    """Last error of every key whose latest outcome is an error."""
    outcomes = events.filter(is_error | is_success)
    last = outcomes.groupBy(key).agg(
        F.max_by(
            F.struct(is_error.alias("failed"), F.col(message).alias("message")),
            F.struct(*order),
        ).alias("_last")
    )
    return last.filter("_last.failed").select(key, F.col("_last.message").alias("error"))


def error_map(errors: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Map form of ``error_by_key`` per group, for groups known to be small."""
    entry = F.struct(F.col(key), F.col("error"))
    return errors.groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("errors")
    )


def branch_progress(
    items: DataFrame,
    closed: DataFrame,
    branch: str,
    key: str,
    position: str,
) -> DataFrame:
    """Per branch: total, done, skipped, pending, next item, finished.

    ``closed`` has (key, state) with state done or skipped; done wins.
    """
    status = closed.groupBy(key).agg(F.min("state").alias("_state"))
    joined = items.join(status, key, "left")
    open_ = F.col("_state").isNull()
    out = joined.groupBy(branch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_state") == "done").alias("done"),
        F.count_if(F.col("_state") == "skipped").alias("skipped"),
        F.count_if(open_).alias("pending"),
        F.min_by(F.when(open_, F.col(key)), F.when(open_, F.col(position))).alias("next_item"),
    )
    return out.withColumn("finished", F.col("pending") == 0)


def next_branch(progress: DataFrame, branch_index: str) -> DataFrame:
    """Lowest index among the branches that still have work."""
    return progress.filter(~F.col("finished")).agg(F.min(branch_index).alias("next_branch"))


def cursor_steps(
    events: DataFrame,
    key: str,
    order: Sequence[str],
    chunk: Column | None,
    took: Column,
    failed: Column,
) -> DataFrame:
    """Effect of events on each cursor: (taken, failures, total, lowest).

    A taken item moves a cursor by +1, a failed publish by -1 but not below 0.
    With S the running sum of steps, ``total`` is the last S and ``lowest`` the
    least of 0 and all S; a cursor c then becomes max(c + total, total - lowest).
    Chunks compose the same way, so no branch is walked by one task; without
    ``chunk`` the time slices are sized from the events.
    """
    if chunk is None:
        chunk = chunked.by_quantiles(events, order[0])
    step = F.when(took, 1).when(failed, -1).otherwise(0)
    df, (k,) = chunked.keyed(
        events.withColumn(chunked.CHUNK, chunk).withColumn("_step", step), [key]
    )
    local = Window.partitionBy(k, chunked.CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    parts = (
        df.withColumn("_run", F.sum("_step").over(local))
        .groupBy(k, chunked.CHUNK)
        .agg(
            F.sum("_step").alias("_sum"),
            F.min("_run").alias("_low"),
            F.count_if(took).alias("taken"),
            F.count_if(failed).alias("failures"),
        )
    )
    before = chunked.prefix_sums(parts, [k], ["_sum"]).withColumnRenamed("_sum", "_before")
    merged = parts.join(before, [k, chunked.CHUNK], "left")
    return merged.groupBy(F.col(f"{k}.{key}").alias(key)).agg(
        F.sum("taken").alias("taken"),
        F.sum("failures").alias("failures"),
        F.sum("_sum").alias("total"),
        F.least(F.lit(0), F.min(F.col("_before") + F.col("_low"))).alias("lowest"),
    )


def queue_cursor(
    events: DataFrame,
    key: str,
    order: Sequence[str],
    chunk: Column | None,
    took: Column,
    failed: Column,
) -> DataFrame:
    """Final cursor per branch, starting from 0."""
    return cursor_steps(events, key, order, chunk, took, failed).select(
        key, "taken", "failures",
        F.greatest(F.col("total"), F.col("total") - F.col("lowest")).cast("bigint").alias("cursor"),
    )
