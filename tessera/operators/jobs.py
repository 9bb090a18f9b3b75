"""Jobs: queue order, moves, reuse of running jobs, states, pending work; and views of a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States after which a job doesn't change, and those that count as processing.
TERMINAL = ("done", "failed", "canceled")
PROCESSING = ("processing", "observed", "segments_ready", "translating")


def queue_name(priority: Column, tag: Column, job: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad(priority.cast("string"), 3, "0"), F.lit("__"), tag, F.lit("__"), job, F.lit(".q"))


def queued(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue items in order, with their jobs where these are known."""
    order = Window.orderBy("priority", "tag", "job_id")
    return items.join(jobs, "job_id", "left").withColumn("place", F.row_number().over(order))


def moved(queue: DataFrame, job: str, how: str, steps: int = 1) -> DataFrame:
    """places after one job moved up, down, to the top or to the bottom, within the queue's bounds."""
    at = F.max(F.when(F.col("job_id") == job, F.col("place"))).over(Window.partitionBy())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    goal = {"up": F.greatest(F.lit(1), at - steps), "down": F.least(n, at + steps), "top": F.lit(1), "bottom": n}[how]
    rows = queue.withColumn("_at", at).withColumn("_goal", goal)
    p, a, g = F.col("place"), F.col("_at"), F.col("_goal")
    place = F.when(p == a, g).when((p > a) & (p <= g), p - 1).when((p < a) & (p >= g), p + 1).otherwise(p)
    return rows.withColumn("place", F.when(a.isNull(), p).otherwise(place).cast("int")).drop("_at", "_goal")


def reusable(requests: DataFrame, jobs: DataFrame, now: float) -> DataFrame:
    """(request_id, job_id): the earliest live job with the same signature (nulls are alike); a leased job
    whose lease has run out isn't live."""
    live = jobs.where(~F.col("state").isin(*TERMINAL) & (F.col("lease_until").isNull() | (F.col("lease_until") > now))).alias("j")
    keys = ("video_id", "job_type", "profile", "variant", "language", "source_language")
    same = None
    for k in keys:
        one = F.col(f"r.{k}").eqNullSafe(F.col(f"j.{k}"))
        same = one if same is None else same & one
    return requests.alias("r").join(live, same).groupBy("r.request_id").agg(F.min_by(F.col("j.job_id"), F.struct("j.created_at", "j.job_id")).alias("job_id"))


def current(events: DataFrame) -> DataFrame:
    """The state of each job from its log (job_id, at, seq, state): the latest entry, and when it began and
    ended. A job that has ended stays ended."""
    ended = F.col("state").isin(*TERMINAL)
    order = F.struct(ended.alias("e"), "at", "seq")
    first_end = F.min(F.when(ended, F.col("at")))
    return events.groupBy("job_id").agg(F.max_by("state", order).alias("state"), F.min("at").alias("created_at"), F.min(F.when(F.col("state") == "running", F.col("at"))).alias("started_at"), first_end.alias("finished_at"), F.count(F.lit(1)).alias("entries"))


def stale(jobs: DataFrame, now: float) -> DataFrame:
    """Jobs to put back: leased or running with a lease that is missing or over."""
    return jobs.where(F.col("state").isin("leased", "running") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))).select("job_id", F.lit("queued").alias("state"))


def most_recent_running(jobs: DataFrame) -> DataFrame:
    """The running job updated last; of equal ones the first."""
    at = F.coalesce("updated_at", "started_at", "created_at")
    return jobs.where("state = 'running'").withColumn("at", at).orderBy(F.desc("at"), "job_id").limit(1)


def matrix(**levels: list) -> str:
    """SQL of all combinations of a few levels."""
    tables = [f"(SELECT explode(array({', '.join(repr(x) for x in xs)})) AS {name})" for name, xs in levels.items()]
    return "SELECT * FROM " + " CROSS JOIN ".join(tables)


def pending(wanted: DataFrame, ready: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not ready."""
    return wanted.join(ready.select(*keys).distinct(), keys, "left_anti")


def follow_ups(finished: DataFrame, languages: dict[str, int]) -> DataFrame:
    """Jobs that a finished process job asks for: indexing, and translation into each other language."""
    jobs = F.concat(F.array(F.struct(F.lit("index").alias("job_type"), F.col("language").alias("target"), F.lit(25).alias("priority"))), *[F.array(F.struct(F.lit("translate").alias("job_type"), F.lit(t).alias("target"), F.lit(p).alias("priority"))) for t, p in languages.items()])
    return finished.select("job_id", "video_id", "language", F.explode(jobs).alias("x")).where((F.col("x.job_type") == "index") | (F.col("x.target") != F.col("language"))).select("job_id", "video_id", "x.*")


def without_video(jobs: DataFrame, video: str) -> DataFrame:
    """The jobs after a video is deleted: its queued jobs are canceled; a running one is an error."""
    own = F.col("video_id") == video
    state = F.when(own & F.col("state").isin("running", "leased"), F.raise_error(F.lit("the video is being processed"))).when(own & (F.col("state") == "queued"), "canceled").otherwise(F.col("state"))
    return jobs.withColumn("state", state)


def library_status(status: Column, languages: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s.isin(*PROCESSING), "processing").when(s == "failed", "failed").when(F.size(languages) > 0, "ready").otherwise("raw")


def library_tags(summary: Column, languages: Column, variants: Column) -> Column:
    other = (F.size(languages) > 1) | F.exists(languages, lambda x: F.lower(F.trim(x)) != "en")
    return F.array_compact(F.array(F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", "summary"), F.when(other, "translated"), F.when(F.size(variants) > 0, "variants"), F.when(F.size(languages) > 0, "outputs")))


def library(videos: DataFrame, status: str | None = None, tag: str | None = None, days: int | None = None, now: float = 0.0, text: str = "", sort: str = "newest") -> DataFrame:
    """Library items (video_id, filename, mtime, status, languages, variants, summary) that pass all filters,
    in order."""
    rows = videos.withColumn("status", library_status(F.col("status"), F.col("languages"))).withColumn("tags", library_tags(F.col("summary"), F.col("languages"), F.col("variants")))
    if status:
        rows = rows.where(F.col("status") == status)
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    if days is not None:
        rows = rows.where(F.col("mtime") >= now - 86400.0 * days)
    if text.strip():
        hay = F.lower(F.concat_ws(" ", "video_id", "filename", "summary", "languages", "tags"))
        rows = rows.where(hay.contains(text.strip().lower()))
    order = {"newest": [F.desc("mtime"), F.col("video_id")], "oldest": [F.col("mtime"), F.col("video_id")], "name": [F.lower("filename"), F.col("video_id")]}[sort]
    return rows.orderBy(*order)


def translated(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments with the text translated at their place, or their own where there is none or it is blank."""
    t = translations.select("video_id", "pos", F.col("text").alias("_t"))
    return segments.join(t, ["video_id", "pos"], "left").withColumn("text", F.coalesce(F.nullif(F.trim("_t"), F.lit("")), F.col("text"))).drop("_t")


# What roles of workers do, and where jobs of a kind stand in the queue.
ROLES = {"gpu": ("process",), "worker_gpu": ("process",), "mt": ("translate",), "worker_mt": ("translate",), "cpu": ("index", "summary_polish"), "worker_cpu": ("index", "summary_polish")}
PRIORITIES = {"process": 10, "translate": 20, "summary_polish": 25, "index": 30}


def priority_of(job_type: Column) -> Column:
    """Where a job of this kind stands in the queue; other kinds stand first."""
    out = F.lit(min(PRIORITIES.values()))
    for name, value in PRIORITIES.items():
        out = F.when(F.lower(F.trim(F.coalesce(job_type, F.lit("")))) == name, value).otherwise(out)
    return out


def claimed(queue: DataFrame, role: str, paused: bool = False) -> DataFrame:
    """The queue (job_id, job_type, place) with claim: run for what a worker of this role may do, requeue (with the
    priority of its kind) for the rest, wait for all while the queue is paused. Other roles do everything."""
    kinds = ROLES.get(role.strip().lower())
    mine = F.lit(True) if kinds is None else F.lower(F.trim(F.coalesce("job_type", F.lit("")))).isin(*kinds)
    claim = F.lit("wait") if paused else F.when(mine, "run").otherwise("requeue")
    return queue.withColumn("claim", claim).withColumn("priority", F.when(F.col("claim") == "requeue", priority_of(F.col("job_type"))))


def leased(jobs: DataFrame, worker: str, now: float, seconds: float, most: int) -> DataFrame:
    """The jobs (job_id, state, lease_until, place) after a worker has taken the first ``most`` that are queued, for
    so many seconds."""
    turn = F.row_number().over(Window.partitionBy(F.col("state") == "queued").orderBy("place", "job_id"))
    rows = jobs.withColumn("_take", (F.col("state") == "queued") & (turn <= most))
    return rows.withColumn("state", F.when(F.col("_take"), "leased").otherwise(F.col("state"))).withColumn("owner", F.when(F.col("_take"), worker)).withColumn("lease_until", F.when(F.col("_take"), now + seconds).otherwise(F.col("lease_until"))).drop("_take")


def heard(jobs: DataFrame, beats: DataFrame, seconds: float) -> DataFrame:
    """The jobs after heartbeats (job_id, owner, at): a lease is put off by its owner's last beat, if it wasn't over."""
    last = beats.groupBy("job_id", F.col("owner").alias("_owner")).agg(F.max("at").alias("_at"))
    rows = jobs.join(last.withColumnRenamed("job_id", "_job"), (F.col("job_id") == F.col("_job")) & (F.col("owner") == F.col("_owner")), "left")
    alive = F.col("_at").isNotNull() & (F.col("_at") <= F.col("lease_until")) & F.col("state").isin("leased", "running")
    return rows.withColumn("lease_until", F.when(alive, F.greatest("lease_until", F.col("_at") + seconds)).otherwise(F.col("lease_until"))).drop("_job", "_owner", "_at")


def created(requests: DataFrame, jobs: DataFrame, now: float) -> DataFrame:
    """(request_id, job_id, is_new, priority): the live job that a request asks for again, or a new one, named by
    what is asked, so that requests that are alike make one."""
    keys = ("video_id", "job_type", "profile", "variant", "language", "source_language")
    found = requests.join(reusable(requests, jobs, now), "request_id", "left")
    name = F.concat(F.lit("job_"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])), 1, 12))
    return found.select("request_id", F.coalesce(F.col("job_id").cast("string"), name).alias("job_id"), F.col("job_id").isNull().alias("is_new"), priority_of(F.col("job_type")).alias("priority"))


def failure_entries(failed: DataFrame) -> DataFrame:
    """(video_id, kind, name, status, error): what a job's failure (job_id, job_type, video_id, variant, language, error)
    leaves behind: in the manifest of its language, in its batch if it is a process job, at the job, in the index."""
    def entry(kind: str, name: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    kind = F.lower(F.trim(F.coalesce("job_type", F.lit(""))))
    video, told = (F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("video_id", "language"))
    variant = F.coalesce(F.nullif("variant", F.lit("")), F.lit("base"))
    entries = F.array_compact(F.array(entry("manifest", F.concat_ws("/", variant, F.lower("language")), video & told & kind.isin("process", "translate")), entry("batch", variant, video & (kind == "process")), entry("job", F.col("job_id"), F.lit(True)), entry("index", F.lit("state"), F.lit(True))))
    return failed.select("job_id", "video_id", "error", F.explode(entries).alias("x")).select("job_id", "video_id", "x.kind", "x.name", F.lit("failed").alias("status"), "error")


def variant_jobs(batches: DataFrame) -> DataFrame:
    """One job of a batch (batch_id, video_id, variant_ids) for each of its variants."""
    return batches.select("batch_id", "video_id", F.posexplode("variant_ids").alias("pos", "variant")).withColumn("job_id", F.concat_ws("_", "batch_id", "variant"))


def stopped(jobs: DataFrame, flags: DataFrame) -> DataFrame:
    """The jobs (job_id, state) after flags (job_id, at, action): the last pause, resume or cancel of each counts; a job
    that has ended stays as it is, and a running one ends at its next step (cancel_requested)."""
    last = flags.groupBy("job_id").agg(F.max_by("action", "at").alias("_action"))
    rows = jobs.join(last, "job_id", "left")
    live = ~F.col("state").isin(*TERMINAL)
    cancel = live & (F.col("_action") == "cancel")
    waiting = F.col("state").isin("queued", "paused")
    state = F.when(cancel & waiting, "canceled").when(live & waiting & (F.col("_action") == "pause"), "paused").when((F.col("state") == "paused") & (F.col("_action") == "resume"), "queued").otherwise(F.col("state"))
    return rows.select(*[c for c in jobs.columns if c != "state"], state.alias("state"), F.coalesce(cancel & ~waiting, F.lit(False)).alias("cancel_requested"))
