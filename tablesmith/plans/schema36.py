"""A schema of 36 tables from end to end: generators by rule, synthesis in dependency order, then every check of its keys and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import assign, checks, synth
from tablesmith.plans.queries import one, query
from tablesmith.spec import SchemaSpec

#: Each table's columns beside the key ``id``: name, then ``>table`` (optional: ``?``), a type, ``e:`` an enumeration, ``u:`` a unique type.
TABLES = """
venue: name varchar(80), opened date, seats integer
hall: venue_id >venue, code char(36), seats integer
zone: hall_id >hall, label varchar(12), factor numeric(4,2)
genre: parent_id >genre?, title varchar(60)
play: genre_id >genre, title varchar(120), minutes integer, fee numeric(9,2)
part: play_id >play, name varchar(60), lines integer
troupe: home_id >venue, lead_id >artist?, founded_year integer
artist: troupe_id >troupe, mentor_id >artist?, email u:varchar(120), skill e:voice|dance|stage|sound
steward: chief_id >steward, badge u:varchar(40)
season: title varchar(40), opens date, budget numeric(15,2)
staging: play_id >play, troupe_id >troupe, season_id >season, state e:draft|booked|playing|closed
casting: staging_id >staging, artist_id >artist, part_id >part, understudy_id >artist?
showing: staging_id >staging, hall_id >hall, starts_at timestamp
rehearsal: staging_id >staging, hall_id >hall?, starts_at timestamp
patron: email u:varchar(120), joined_at timestamp, city varchar(60)
membership: patron_id >patron, tier e:friend|gold|patron, fee numeric(8,2)
voucher_batch: season_id >season, pieces integer
voucher: batch_id >voucher_batch, code u:varchar(40), worth numeric(8,2)
booking: patron_id >patron, showing_id >showing, voucher_id >voucher?, channel e:web|desk|phone
ticket: booking_id >booking, zone_id >zone, price numeric(7,2)
refund: ticket_id >ticket, cleared_by >steward?, state e:asked|granted|refused
duty: steward_id >steward, showing_id >showing
stock_room: venue_id >venue, shelf varchar(10)
prop: staging_id >staging?, room_id >stock_room, title varchar(80)
prop_loan: prop_id >prop, artist_id >artist, due date
carrier: name varchar(80), rating numeric(3,2)
delivery: carrier_id >carrier, room_id >stock_room, state e:ordered|moving|there
donor: account u:bigint, pledge numeric(20,0), share numeric(3,2)
award: donor_id >donor, staging_id >staging?, amount numeric(14,2)
opinion: patron_id >patron, showing_id >showing, stars integer
sensor: hall_id >hall, name varchar(30)
"""
#: Tables without ``id``: key columns first.
KEYED = {
    "climate_day": {"sensor_id": {"type": "bigint", "fk": "sensor.id", "pk": True}, "day": {"type": "date", "pk": True}, "degrees": {"type": "integer"}},
    "rota": {"steward_id": {"type": "bigint", "fk": "steward.id", "pk": True}, "begins": {"type": "time", "pk": True}, "remark": {"type": "varchar", "ddl_type": "varchar(30)"}},
    "closing_day": {"day": {"type": "date", "pk": True}, "reason": {"type": "text"}},
    "bell": {"rings": {"type": "time", "pk": True}, "tune": {"type": "varchar", "ddl_type": "varchar(20)"}},
    "alarm": {"raised_at": {"type": "timestamp", "pk": True}, "place": {"type": "varchar", "ddl_type": "varchar(30)"}},
}


def column(text: str) -> dict:
    if text.startswith(">"):
        return {"type": "bigint", "fk": f"{text[1:].rstrip('?')}.id", "nullable": text.endswith("?")}
    if text.startswith("e:"):
        return {"type": "text", "enum_values": text[2:].split("|")}
    kind = text.removeprefix("u:")
    return {"type": kind.partition("(")[0], "ddl_type": kind, "unique": text.startswith("u:")}


def schema() -> SchemaSpec:
    tables = {}
    for line in TABLES.strip().splitlines():
        name, _, rest = line.partition(": ")
        tables[name] = {"id": {"type": "bigint", "pk": True}} | {c: column(kind) for c, kind in (x.split(" ", 1) for x in rest.replace(", ", "\n").splitlines())}
    return SchemaSpec.of(tables | KEYED)


SPEC = schema()
REFERENCES = sorted((t, c, *v.parent) for t, columns in SPEC.tables.items() for c, v in columns.items() if v.parent)


def assigned_spec(spark) -> SchemaSpec:
    """The schema with the generator that the rules give to each column."""
    rows = [(t, c, v.type, v.ddl_type or v.type, v.pk, v.unique, v.enum_values) for t, columns in sorted(SPEC.tables.items()) for c, v in columns.items()]
    catalog = spark.createDataFrame(rows, "table string, column string, type string, ddl_type string, pk boolean, unique boolean, enum_values array<string>")
    spec = schema()
    for r in assign.assign_generators(catalog).select("table", "column", "generator").collect():  # a row for each column of the schema
        spec.tables[r["table"]][r["column"]].generator = r["generator"] or None
    return spec


def filled(spark, sf_dir: str) -> synth.Synthesis:
    """As many rows in each table as there are suppliers, and all days (or times) in one that is keyed by these and has fewer."""
    spec, n = assigned_spec(spark), one(spark, sf_dir, "supplier").count()
    return synth.synthesize(spark, spec, rows=n, table_rows=full_tables(spec, n), seed=36)


def full_tables(spec: SchemaSpec, n: int) -> dict[str, int]:
    """The tables whose key has fewer than ``n`` values, with their number."""
    sizes = {t: synth.type_capacity(spec, t) for t in spec.tables}
    return {t: size for t, size in sizes.items() if size is not None and size < n}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}.{c}', CAST(0 AS BIGINT))" for t, c, _, _ in REFERENCES) + ') AS v("check", violations) WHERE (SELECT count(*) FROM supplier) > 0')
def x1_orphans_of_36_tables(spark, sf_dir):
    """Every reference of the schema: none has an orphan."""
    made = filled(spark, sf_dir).tables
    return checks.report({f"{t}.{c}": checks.orphans(made[t], c, made[p], ref) for t, c, p, ref in REFERENCES})


def rules() -> dict[str, tuple]:
    """By name: a table and what breaks a key, a unique column, an enumeration or a precision of it."""
    found = {}
    for t, columns in SPEC.tables.items():
        found[f"{t}: key"] = t, lambda df, keys=SPEC.keys(t): checks.duplicates(df, *keys)
        for c, v in columns.items():
            if v.unique:
                found[f"{t}.{c}: unique"] = t, lambda df, c=c: checks.duplicates(df, c)
            if v.enum_values:
                found[f"{t}.{c}: domain"] = t, lambda df, c=c, values=v.enum_values: checks.outside_domain(df, c, values)
            if v.type == "numeric":
                digits, scale = v.precision()
                found[f"{t}.{c}: range"] = t, lambda df, c=c, top=10 ** (digits - scale): df.filter((F.col(c) < 0) | (F.col(c) >= F.lit(str(top)).cast("decimal(38,0)")) | F.col(c).isNull())
    return found


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', CAST(0 AS BIGINT))" for name in rules()) + ') AS v("check", violations) WHERE (SELECT count(*) FROM supplier) > 0')
def x2_keys_and_domains_of_36_tables(spark, sf_dir):
    """Keys, unique columns, enumerations and precisions of every table: nothing breaks them."""
    made = filled(spark, sf_dir).tables
    return checks.report({name: check(made[t]) for name, (t, check) in rules().items()})


@query("SELECT 'genre' AS \"table\", n, CAST(1 AS BIGINT) AS roots, CAST(0 AS BIGINT) AS too_deep FROM (SELECT count(*) AS n FROM supplier) UNION ALL SELECT 'steward', count(*), 1, 0 FROM supplier")
def x3_trees_of_36_tables(spark, sf_dir):
    """The self-references of the schema: one root each, nothing deeper than two steps."""
    made, trees = filled(spark, sf_dir).tables, {"genre": "parent_id", "steward": "chief_id"}
    parts = []
    for t, c in trees.items():
        counts = made[t].agg(F.count("*").alias("n")).withColumn("table", F.lit(t))
        roots = checks.summary(checks.roots(made[t], c, "id"), t).select(F.col("check").alias("table"), F.col("violations").alias("roots"))
        deep = checks.summary(checks.depth_violations(made[t], "id", c, 2), t).select(F.col("check").alias("table"), F.col("violations").alias("too_deep"))
        parts.append(counts.join(roots, "table").join(deep, "table").select("table", "n", "roots", "too_deep"))
    return parts[0].unionByName(parts[1])
