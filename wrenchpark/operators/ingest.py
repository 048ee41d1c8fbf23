"""Incoming records: validation, creation, comments, references, seeds and
table contracts.

Each check is a Column expression, so validating a batch is one narrow
projection of the input (no shuffle).  Rows are split into accepted and
rejected by the size of their error list; every input row lands in exactly
one of the two.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.parse import DECIMAL_RE, EMAIL_RE, ISO_DATE_RE, decimal_text
from ..functions.text import preview, trim_to_null, utrim
from ..session import checkpoint_dir
from .dims import Dim, as_dim

# --- Fixed values: validation messages of the source system, by field ---
MESSAGES = {
    "description": "La descripción es obligatoria.",
    "location_id": "Selecciona una ubicación.",
    "type_id": "Selecciona un tipo.",
    "status_id": "Selecciona un estado.",
    "net_value": "Valor neto inválido.",
    "created_by_email": "Correo inválido.",
    "repair_date": "Fecha inválida.",
    "due_date": "Fecha objetivo inválida.",
    "owner_email": "Correo de responsable inválido.",
}
# --- end of fixed values ---


ID_FIELDS = ["location_id", "type_id", "status_id", "priority_id"]
TEXT_FIELDS = ["created_by_name", "created_by_email", "provider", "purchase_order", "requested_by",
               "notes", "owner_name", "owner_email", "repair_date", "due_date"]


def validate(records: DataFrame, mode: str = "create") -> DataFrame:
    """Check form records and type their values.

    Adds ``errors`` (array of failing field names, empty when valid; see
    :func:`error_messages` for the texts) and the typed job columns.
    ``mode='update'`` also requires a status.

    Every parsed value is one ``regexp_extract`` + ``try_cast`` of the trimmed
    text (no match gives '' and ``try_cast('')`` is NULL), so each text is
    read once even after Catalyst inlines the projections into a filter.
    Numbers follow JavaScript ``Number()`` on decimal text: an id is a whole
    number (``'7.0'`` and ``'1e1'`` count), an amount may use a decimal comma.
    """
    raw = {n: (F.col(n) if n in records.columns else F.lit(None).cast("string"))
           for n in ["description", "net_value", *ID_FIELDS, *TEXT_FIELDS]}
    keep = [c for c in records.columns if c not in raw]
    t = {c: utrim(raw[c]) for c in [*ID_FIELDS, *TEXT_FIELDS]}
    desc_t = utrim(F.coalesce(raw["description"], F.lit("")))

    def whole(c: str) -> Column:
        # Through a double, as the source does: the nearest one decides whether a text is whole.
        n = F.regexp_extract(t[c], DECIMAL_RE, 0).try_cast("double")
        return F.when(n == F.rint(n), n.try_cast("int"))

    def text_or_null(c: str) -> Column:
        return F.when(F.length(t[c]) > 0, t[c])

    net_raw = raw["net_value"]
    net_t = decimal_text(net_raw)
    typed = {
        "description": F.when(F.length(desc_t) > 0, F.substring(desc_t, 1, S.DESCRIPTION_MAX))
                        .otherwise(F.coalesce(raw["description"], F.lit(""))),
        "location_id": whole("location_id"),
        "type_id": whole("type_id"),
        "status_id": whole("status_id"),
        "net_value": (F.when(net_raw.isNull() | (net_raw == ""), F.lit(None).cast("decimal(12,2)"))
                       .when(net_t == "", F.lit(0).cast("decimal(12,2)"))
                       .otherwise(F.regexp_extract(net_t, DECIMAL_RE, 0).try_cast("decimal(12,2)"))),
        **{c: text_or_null(c) for c in ("created_by_name", "created_by_email", "provider", "purchase_order",
                                        "requested_by", "notes", "owner_name", "owner_email")},
        "repair_date": F.regexp_extract(t["repair_date"], ISO_DATE_RE, 0).try_cast("date"),
        "priority_id": F.nullif(whole("priority_id"), F.lit(0)),    # empty or 0 is "no priority"
        "due_date": F.regexp_extract(t["due_date"], ISO_DATE_RE, 0).try_cast("date"),
    }
    flags = {
        "__desc_empty": F.length(desc_t) == 0,
        "__net_given": F.coalesce(net_raw != "", F.lit(False)),
        "__rep_given": F.coalesce(F.length(t["repair_date"]) > 0, F.lit(False)),
        "__due_given": F.coalesce(F.length(t["due_date"]) > 0, F.lit(False)),
        "__mail_c_ok": F.coalesce(t["created_by_email"].rlike(EMAIL_RE), F.lit(True)),
        "__mail_o_ok": F.coalesce(t["owner_email"].rlike(EMAIL_RE), F.lit(True)),
    }
    staged = records.select(*keep, *[v.alias(k) for k, v in typed.items()],
                            *[v.alias(k) for k, v in flags.items()])

    bads: list[Column] = []

    def err(field: str, bad: Column) -> Column:
        bads.append(F.coalesce(bad, F.lit(False)))
        return F.when(bad, F.lit(field))

    checks = [
        err("description", F.col("__desc_empty")),
        err("location_id", F.coalesce(F.col("location_id"), F.lit(0)) == 0),
        err("type_id", F.coalesce(F.col("type_id"), F.lit(0)) == 0),
        err("net_value", F.col("__net_given") & F.col("net_value").isNull()),
        err("created_by_email", F.col("created_by_email").isNotNull() & ~F.col("__mail_c_ok")),
        err("repair_date", F.col("__rep_given") & F.col("repair_date").isNull()),
        err("due_date", F.col("__due_given") & F.col("due_date").isNull()),
        err("owner_email", F.col("owner_email").isNotNull() & ~F.col("__mail_o_ok")),
    ]
    if mode == "update":
        checks.insert(3, err("status_id", F.coalesce(F.col("status_id"), F.lit(0)) == 0))
    # The verdict leaves through a generator (one struct per row): filters on
    # ``valid`` then stay above it instead of being pushed down with every
    # parsing expression inlined, so each row is parsed once.
    verdict = F.struct(*[F.col(c) for c in typed], F.array_compact(F.array(*checks)).alias("errors"),
                       (~reduce(lambda a, b: a | b, bads)).alias("valid"))
    return staged.select(*keep, F.inline(F.array(verdict)))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("valid")).drop("errors", "valid")


def accepted_updates(validated: DataFrame) -> DataFrame:
    """Records that are valid as updates, from records validated as new jobs: an
    update also needs a status, all other rules are the same."""
    return accepted(validated).where(F.coalesce(F.col("status_id"), F.lit(0)) != 0)


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("valid")).drop("valid")


def write_validated(records: DataFrame, path: str, mode: str = "create", write_mode: str = "errorifexists") -> None:
    """Validate once and write both outcomes in one pass: ``outcome=accepted``
    and ``outcome=rejected`` partitions under ``path``.  Readers of either
    side prune to their partition instead of validating the batch again."""
    v = validate(records, mode)
    outcome = F.when(F.col("valid"), F.lit("accepted")).otherwise(F.lit("rejected"))
    v.withColumn("outcome", outcome).drop("valid").write.mode(write_mode).partitionBy("outcome").parquet(path)


def error_fields(col: str = "errors") -> Column:
    return F.array_join(F.col(col), ",")


def error_messages(col: str = "errors") -> Column:
    """Map of failing field to its message (for rejected rows only)."""
    msgs = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return F.map_from_arrays(F.col(col), F.transform(col, lambda f: msgs[f]))


def lookup_id(names: DataFrame, name_col: str, catalog: Dim | DataFrame, out: str = "id") -> DataFrame:
    """Case-insensitive name to id; NULL when the name is unknown."""
    cat = as_dim(catalog)
    right = cat.for_join().select(F.lower("name").alias("__k"), F.col("id").alias(out))
    return names.join(right, F.lower(F.col(name_col)) == F.col("__k"), "left").drop("__k")


def assign_ids(df: DataFrame, order_by: list[str], base: int, out: str = "id") -> DataFrame:
    """Number rows ``base+1, base+2, ...`` in ``order_by`` order without a
    single-task window.

    The rows are range-sorted and checkpointed (so partitions are fixed), each
    partition is counted, the few counts get running offsets, and a row's
    number is its partition offset plus its position inside the partition.
    """
    checkpoint_dir(df.sparkSession)
    frozen = df.orderBy(*order_by).checkpoint(eager=True)
    tagged = frozen.select("*", F.spark_partition_id().alias("__pid"),
                           F.monotonically_increasing_id().alias("__mid"))
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: the running sum is bounded by the partition count.
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "__pid")
            .withColumn(out, F.lit(base).cast("bigint") + F.col("__off") + local + 1)
            .drop("__pid", "__mid", "__off"))


def create_jobs(valid: DataFrame, existing_jobs: DataFrame, statuses: Dim | DataFrame, as_of: str,
                order_by: list[str], default_name: str | None = None,
                default_email: str | None = None, catalogs: Mapping[str, Dim] | None = None) -> DataFrame:
    """New job rows from accepted records: status always 'Pendiente' (looked up
    by name), created now (``as_of``), default creator, ids above the current
    maximum in ``order_by`` order.  With ``catalogs``, records that name a
    missing type, location or priority are refused before ids are given
    (:func:`split_known` returns them)."""
    if catalogs is not None:
        valid, _ = split_known(valid, catalogs, CREATE_FK)
    base = existing_jobs.agg(F.max("id")).first()[0] or 0      # one scalar
    # The status id of 'Pendiente' is one catalog lookup (a scalar), as in the source.
    hit = as_dim(statuses).df.where(F.lower("name") == "pendiente").select("id").first()
    pending = hit[0] if hit else None
    rows = valid.select(
        *[c for c in valid.columns if c not in ("status_id", "created_at", "created_by_name", "created_by_email")],
        F.lit(pending).cast("int").alias("status_id"),
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
        F.coalesce(F.col("created_by_name"), F.lit(default_name)).alias("created_by_name"),
        F.coalesce(F.col("created_by_email"), F.lit(default_email)).alias("created_by_email"),
    )
    return assign_ids(rows, order_by, base)


def comments_split(incoming: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New comments: text trimmed and non-empty, parent job present.
    Returns (accepted, rejected with a reason); one join to the job table
    decides both."""
    parents = jobs.select(F.col("id").alias("__parent"))
    c = (incoming.withColumn("comment", trim_to_null(F.col("comment")))
         .join(parents, F.col("job_id") == F.col("__parent"), "left")
         .withColumn("reason", F.when(F.col("comment").isNull(), "empty").when(F.col("__parent").isNull(), "not_found"))
         .drop("__parent"))
    acc = c.where(F.col("reason").isNull()).drop("reason").withColumn("preview", preview("comment", S.PREVIEW_CHARS))
    return acc, c.where(F.col("reason").isNotNull())


FK_COLUMNS = (("status_id", "status"), ("type_id", "type"), ("location_id", "location"),
              ("priority_id", "priority"))


# A new job's status is given, so only the other references come from its record.
CREATE_FK = FK_COLUMNS[1:]


def split_known(rows: DataFrame, catalogs: Mapping[str, Dim],
                columns: tuple[tuple[str, str], ...] = FK_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Rows whose references all exist, and the others with ``reason``: a comma
    list of ``fk:<catalog>``.  A NULL reference is not looked up."""
    df = _with_known(rows, catalogs, columns)
    broken = [F.when(F.col(col).isNotNull() & F.col(f"__k_{cat}").isNull(), F.lit(f"fk:{cat}")) for col, cat in columns]
    df = df.withColumn("reason", F.concat_ws(",", *broken)).drop(*[f"__k_{cat}" for _, cat in columns])
    return df.where("reason = ''").drop("reason"), df.where("reason <> ''")


def _with_known(rows: DataFrame, catalogs: Mapping[str, Dim],
                columns: tuple[tuple[str, str], ...] = FK_COLUMNS) -> DataFrame:
    """Rows with a ``__k_<catalog>`` column: the catalog id when the row's id
    exists there, NULL otherwise (left joins to size-checked catalogs)."""
    df = rows
    for col, cat in columns:
        known = catalogs[cat].for_join().select(F.col("id").alias(f"__k_{cat}"))
        df = df.join(known, df[col] == known[f"__k_{cat}"], "left")
    return df


def _fk_breaks() -> list[Column]:
    return [F.when(F.col(col).isNotNull() & F.col(f"__k_{cat}").isNull(),
                   F.struct(F.lit(cat).alias("catalog"), F.col(col).cast("int").alias("value")))
            for col, cat in FK_COLUMNS]


def fk_violations(rows: DataFrame, catalogs: Mapping[str, Dim], id_col: str = "id") -> DataFrame:
    """Rows whose catalog ids do not exist: (id, fk, value), from one pass
    over ``rows``.  NULL priority is allowed; the other three are required."""
    df = _with_known(rows.select(F.col(id_col).alias("id"), *[c for c, _ in FK_COLUMNS]), catalogs)
    out = df.select("id", F.explode(F.array_compact(F.array(*_fk_breaks()))).alias("v"))
    return out.select("id", F.concat(F.lit("fk:"), F.col("v.catalog")).alias("fk"), F.col("v.value").alias("value"))


def seed_missing(existing: DataFrame, seed: list[tuple[int, str]], only_if_empty: bool,
                 catalog_name: str) -> DataFrame:
    """Seed rows to insert: all seeds when ``only_if_empty`` and the table is
    empty; otherwise each seed whose name is absent (case-insensitive),
    numbered above the current maximum id."""
    spark = existing.sparkSession
    base, rows = existing.agg(F.coalesce(F.max("id"), F.lit(0)), F.count(F.lit(1))).first()      # two scalars
    if only_if_empty and rows:
        return spark.createDataFrame([], "catalog string, id int, name string")
    seeds = spark.createDataFrame(seed, S.CATALOG).select(F.col("id").alias("seed_pos"), "name")
    absent = seeds.join(existing.select(F.lower("name").alias("__k")), F.lower("name") == F.col("__k"), "left_anti")
    numbered = absent.select(F.lit(catalog_name).alias("catalog"),
                             (F.lit(base) + F.dense_rank().over(Window.orderBy("seed_pos"))).cast("int").alias("id"),
                             "name")
    return numbered


def contract_violations(jobs: DataFrame, catalogs: Mapping[str, Dim], statuses: Dim | None = None) -> DataFrame:
    """One table of contract breaches of the job table: (rule, column, id).

    NOT NULL of required columns, text longer than its limit, foreign keys and
    closed status without a closing time (K4) come from one pass over the
    table (one array of breaches per row, exploded); duplicate ids, and names
    that a catalog has twice (in any case), need one aggregate each.  A missing required column is not a row: it raises, like a
    missing migration.
    """
    missing = [c for c in S.REQUIRED_COLUMNS if c not in jobs.columns]
    if missing:
        raise ValueError(f"migration required: missing columns {missing}")
    st = as_dim(statuses or catalogs["status"]).for_join().select(
        F.col("id").alias("__sid"), (F.lower("name") == F.lit(S.CLOSED_STATUS)).alias("__closed_status"))
    df = _with_known(jobs, catalogs)
    df = df.join(st, df.status_id == st.__sid, "left")

    def brk(rule: str, column: str, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column")))

    checks = [brk("not_null", c, F.col(c).isNull())
              for c in ("created_at", "description", "location_id", "type_id", "status_id")]
    checks += [brk("max_length", c, F.length(c) > n) for c, n in S.TEXT_LIMITS.items() if c in jobs.columns]
    checks += [brk("foreign_key", cat, F.col(col).isNotNull() & F.col(f"__k_{cat}").isNull()) for col, cat in FK_COLUMNS]
    checks.append(brk("closed_without_time", "closed_at",
                      F.coalesce(F.col("__closed_status"), F.lit(False)) & F.col("closed_at").isNull()))
    rows = (df.select("id", F.explode(F.array_compact(F.array(*checks))).alias("b"))
            .select(F.col("b.rule").alias("rule"), F.col("b.column").alias("column"), "id"))
    dup = (jobs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
           .select(F.lit("unique").alias("rule"), F.lit("id").alias("column"), "id"))
    for name, dim in catalogs.items():
        twice = as_dim(dim).df.groupBy(F.lower("name").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))
        dup = dup.unionByName(twice.where("k > 1").select(F.lit("unique").alias("rule"), F.lit(f"{name}.name").alias("column"),
                                                          F.col("id").cast("long").alias("id")))
    return rows.unionByName(dup)
