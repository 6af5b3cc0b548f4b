"""Value generators: pure column expressions of seed, table, column and row."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesmith.functions.hashing import Cells

WORDS = "amber basin cedar delta ember fable grove harbor island jasper kettle lantern meadow nickel orchard pebble quartz river saddle timber umber valley willow yarrow".split()
FIRST = "Ada Ben Cleo Dan Eva Finn Gia Hugo Ida Jon Kai Lea Max Nia Otto Pia".split()
LAST = "Archer Baker Carver Dyer Fisher Glover Hunter Mason Miller Porter Sawyer Turner Walker Weaver".split()
STREETS = ["Main Street", "Oak Avenue", "Mill Lane", "Park Road", "Hill Street", "Lake Drive"]
CITIES = "Ashford Brookton Clearwater Dunmore Eastvale Fairview Glenwood Highfield".split()
STATES = "Northland Southland Eastland Westland Midland Upland".split()
COUNTRIES = "Avaria Borland Cantia Doria Estia Fenland".split()
ADJECTIVES = "Compact Durable Elegant Handmade Light Modern Rustic Smart".split()
PRODUCTS = "Bag Chair Clock Desk Lamp Mug Shelf Table".split()
SUFFIXES = ["Group", "Labs", "Partners", "Works"]
LEVELS = ["Junior", "Senior", "Lead", "Chief"]
JOBS = ["Analyst", "Designer", "Engineer", "Manager", "Planner"]
START = dt.date(2000, 1, 1)
END = dt.date(2025, 12, 31)

BARE = ("bool word sentence name firstname lastname username email phone street city state country zip url uuid ipv4 macaddress hexcolor productname company jobtitle latitude longitude float64 date time datetime json sequence").split()
CALLED = ("number", "price", "randomstring", "paragraph", "float64")
CALL = re.compile(r"^\s*([A-Za-z0-9_]+)\s*(?:\((.*)\))?\s*$", re.DOTALL)
CUSTOM: dict[str, Callable[[Cells, list[str]], Column]] = {}


def register_generator(name: str, fn: Callable[[Cells, list[str]], Column]) -> None:
    """Make ``name`` (and ``name(args)``) a generator; ``fn`` gets the cells and the arguments and returns a Column."""
    CUSTOM[name.lower()] = fn


def parse(generator: str) -> tuple[str, list[str]]:
    """The name and the trimmed arguments of a generator string; values may hold parentheses but no commas."""
    m = CALL.match(generator or "")
    return (m[1].lower(), [a.strip() for a in m[2].split(",")] if m[2] else []) if m else ("", [])


def valid(generator: str) -> bool:
    """Whether a generator string is recognized: empty, a bare name, or a call of one that takes arguments."""
    text = (generator or "").strip()
    called = re.fullmatch(r"(\w+)\(.*\)", text)
    return not text or text in BARE or parse(text)[0] in CUSTOM or bool(called and called[1] in CALLED)


def usable(generator: str) -> bool:
    """Whether a generator string is known and its arguments fit."""
    name, args = parse(generator)
    if name in CUSTOM or (name in BARE and not args) or name == "float64":
        return True
    numbers = all(re.fullmatch(r"-?\d+(\.\d+)?", a) for a in args)
    return (name in ("number", "price") and len(args) == 2 and numbers) or (name == "paragraph" and len(args) <= 1 and numbers) or (name == "randomstring" and len(args) > 0)


def pick(h: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (h % len(values) + 1).cast("int"))


def number(h: Column, low: int, high: int) -> Column:
    return F.lit(low) + h % (high - low + 1)


def price(h: Column, low: float, high: float) -> Column:
    cents, span = round(100 * low), round(100 * high) - round(100 * low) + 1
    return ((F.lit(cents) + h % span).cast("decimal(20,0)") / 100).cast("decimal(18,2)")


def uuid(digest: Column) -> Column:
    """Version 4 shape from 32 hexadecimal digits."""
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def day(offset: Column) -> Column:
    return F.date_add(F.lit(START), offset.cast("int"))


def clock(seconds: Column) -> Column:
    return F.concat_ws(":", *[F.lpad(x.cast("int").cast("string"), 2, "0") for x in (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)])


def instant(seconds: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def _words(cells: Cells, n: int) -> Column:
    """``n`` words in an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: pick(Cells(cells.seed, cells.table, cells.column, F.concat_ws("#", cells.row.cast("string"), i.cast("string")), cells.kind).h("w"), WORDS))


def _sentence(words: Column) -> Column:
    text = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20), F.lit("."))


def generate(generator: str | None, cells: Cells, end: dt.date = END) -> Column:
    """The column that a generator string stands for. An unknown one gives a word (see ``usable`` for warnings), none gives null."""
    if not generator:
        return F.lit(None)
    name, args = parse(generator)
    if name in CUSTOM:
        return CUSTOM[name](cells, args)
    h, days = cells.h(), (end - START).days + 1
    if not usable(generator):
        name = "word"
    if name == "number":
        return number(h, int(float(args[0])), int(float(args[1])))
    if name == "price":
        return price(h, float(args[0]), float(args[1]))
    if name == "randomstring":
        return pick(h, args)
    if name == "paragraph":
        n = int(float(args[0])) if args else 1
        sentences = [F.slice(_words(cells, 24 * n), 8 * i + 1, 8) for i in range(3 * n)]
        return F.concat_ws(" ", *[_sentence(s) for s in sentences])
    if name == "email":
        return F.concat(F.lower(pick(cells.h("f"), FIRST)), F.lit("."), F.lower(pick(cells.h("l"), LAST)), (h % 1_000_000).cast("string"), F.lit("@example.com"))
    known: dict[str, Callable[[], Column]] = {
        "bool": lambda: h % 2 == 0,
        "float64": lambda: h.cast("double") / F.lit(float(1 << 60)),
        "word": lambda: pick(h, WORDS),
        "sentence": lambda: _sentence(_words(cells, 5)),
        "firstname": lambda: pick(h, FIRST),
        "lastname": lambda: pick(h, LAST),
        "name": lambda: F.concat_ws(" ", pick(cells.h("f"), FIRST), pick(cells.h("l"), LAST)),
        "username": lambda: F.concat(pick(cells.h("w"), WORDS), (h % 10_000).cast("string")),
        "phone": lambda: F.lpad((h % 10_000_000_000).cast("string"), 10, "0"),
        "street": lambda: F.concat_ws(" ", (h % 999 + 1).cast("string"), pick(cells.h("s"), STREETS)),
        "city": lambda: pick(h, CITIES),
        "state": lambda: pick(h, STATES),
        "country": lambda: pick(h, COUNTRIES),
        "zip": lambda: F.lpad((h % 100_000).cast("string"), 5, "0"),
        "url": lambda: F.concat(F.lit("https://example.com/"), pick(h, WORDS)),
        "uuid": lambda: uuid(cells.digest()),
        "ipv4": lambda: F.concat_ws(".", *[(F.shiftright(h, 8 * i) % 256).cast("string") for i in range(4)]),
        "macaddress": lambda: F.concat_ws(":", *[F.substring(cells.digest(), 2 * i + 1, 2) for i in range(6)]),
        "hexcolor": lambda: F.concat(F.lit("#"), F.substring(cells.digest(), 1, 6)),
        "productname": lambda: F.concat_ws(" ", pick(cells.h("a"), ADJECTIVES), pick(h, PRODUCTS)),
        "company": lambda: F.concat_ws(" ", pick(cells.h("l"), LAST), pick(h, SUFFIXES)),
        "jobtitle": lambda: F.concat_ws(" ", pick(cells.h("v"), LEVELS), pick(h, JOBS)),
        "latitude": lambda: ((h % 180_000_001).cast("decimal(20,0)") / 1_000_000).cast("decimal(12,6)") - F.lit(90),
        "longitude": lambda: ((h % 360_000_001).cast("decimal(20,0)") / 1_000_000).cast("decimal(12,6)") - F.lit(180),
        "date": lambda: day(h % days),
        "time": lambda: clock(h % 86_400),
        "datetime": lambda: instant(h % (days * 86_400)),
        "json": lambda: F.to_json(F.struct(pick(cells.h("k"), WORDS).alias("key"), pick(cells.h("v"), WORDS).alias("value"))),
        "sequence": lambda: cells.row + 1,
    }
    return known[name]()


def fit_length(value: Column, length: int | None) -> Column:
    """Cut to the first ``length`` code points."""
    return value if length is None else F.substring(value, 1, length)
