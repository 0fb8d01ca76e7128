"""Document fingerprints (op 7): invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its sentences and lines; each becomes a 64-bit digest.
A sketch has cells of (count, xor of digests, xor of their check hashes), and a
digest lies in one cell of each of three tables. Digests are dealt by three of
their bits, as often as needed, until each part's sketch gives its digests back
by peeling, so a part that fails is retried eight times as large. The
fingerprint holds the cells of all these parts.

The likeness of two texts is the share of common paragraphs and comes from the
two fingerprints alone. Where a table of each of two equal parts has no two digests
in one cell, those say what is shared; else the cells subtract, which leaves the
digests they do not share, and peeling counts those. Where that gets stuck, or
one side divides a part that the other does not, the digests recovered from the
undivided cells are dealt to eight sketches and it goes on with those. All of
this is built-in column expressions.

Defined results: a null text is empty; the fingerprint of no paragraphs is
empty; two texts without paragraphs have likeness 1, one without and one with
0; repeated paragraphs count once; a part that no retry decodes (digests that
agree in 40 bits) counts as wholly different unless its cells are equal; rows
follow each other by id (null first), then text hash, so repeated rows are each
other's neighbours; one row alone is its own next; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, keyed, shuffle_partitions
from .quality_rules import let

TABLES = 3
SLOTS = 4  # cells of each table, a power of two
CELLS = TABLES * SLOTS
PEEL_ROUNDS = 8
# Digests of a part. Up to three always peel if no two of them share all cells:
# then some table has one of them alone in a cell, and so on with the rest.
PART = 3
# Eightfold retries; a fingerprint has at most 8**11 parts.
RETRIES = 12
_LEAVES = "array<struct<level:int,part:bigint,cells:array<struct<n:int,k:bigint,c:bigint>>>>"
# The bits of a digest that say its cells.
_PLACES = sum((SLOTS - 1) << (40 + 4 * table) for table in range(TABLES))
_BREAK = r"\n+|(?<=[.!?]) +"


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _in_cell(digest: Column, cell: int) -> Column:
    """Whether a digest lies in a cell: some of its bits say which slot of each
    table it takes."""
    table, slot = divmod(cell, SLOTS)
    shift = 40 + 4 * table
    return digest.bitwiseAND(F.lit((SLOTS - 1) << shift)) == F.lit(slot << shift)


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    parts = F.filter(F.split(text, _BREAK), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def sketch(digests: Column) -> Column:
    """Cells of a set of digests."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    entries = F.transform(digests, lambda x: F.struct(F.lit(1).alias("n"), x.alias("k"), _check(x).alias("c")))
    return let(entries, lambda every: F.array(*[_gathered(zero, every, i, 1) for i in range(CELLS)]))


def subtracted(a: Column, b: Column) -> Column:
    """Cells of one sketch minus those of another."""
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")
    ))


def _gathered(start: Column, entries: Column, i: int, sign: int) -> Column:
    """Cell ``i`` with its entries added, or taken away."""

    def add(cell: Column, x: Column) -> Column:
        return F.when(_in_cell(x["k"], i), F.struct(
            (cell["n"] + sign * x["n"]).alias("n"), cell["k"].bitwiseXOR(x["k"]).alias("k"), cell["c"].bitwiseXOR(x["c"]).alias("c")
        )).otherwise(cell)

    return F.aggregate(entries, start, add)


def _peel(cells: Column, nothing: Column, more: Callable[[Column, Column], Column], stuck: Column) -> Column:
    """``more`` over what was found and what a round finds, ``stuck`` if some
    cell stays."""

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"])))
        return F.when(state["over"], state).otherwise(let(pure, lambda found: F.when(F.size(found) == 0, F.struct(
            state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("over")
        )).otherwise(F.struct(
            F.array(*[_gathered(state["cells"][i], found, i, -1) for i in range(CELLS)]).alias("cells"),
            more(state["found"], found).alias("found"), F.lit(False).alias("over"),
        ))))

    start = F.struct(cells.alias("cells"), nothing.alias("found"), F.lit(False).alias("over"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(PEEL_ROUNDS)), start, step,
        lambda s: F.when(F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)), s["found"]).otherwise(stuck),
    )


def peeled(cells: Column) -> Column:
    """Number of digests that peeling recovers, -1 if some cell stays."""
    return _peel(cells, F.lit(0), lambda n, found: n + F.size(found), F.lit(-1))


def recovered(cells: Column) -> Column:
    """Digests that peeling recovers, null if some cell stays."""
    none = F.array().cast("array<bigint>")
    return _peel(cells, none, lambda ks, found: F.concat(ks, F.transform(found, lambda x: x["k"])), F.lit(None).cast("array<bigint>"))


def stated(cells: Column) -> Column:
    """The digests of a sketch as the first table says them that has each in a
    cell of its own, null if none does."""
    tables = [F.slice(cells, 1 + SLOTS * table, SLOTS) for table in range(TABLES)]
    return F.coalesce(*[
        F.when(F.forall(t, lambda x: x["n"] <= 1), F.transform(F.filter(t, lambda x: x["n"] == 1), lambda x: x["k"])) for t in tables
    ])


def _mask(level: Column, bits: int) -> Column:
    return F.call_function("shiftleft", F.lit(bits).cast("long"), (3 * level).cast("int"))


def _dealt(digests: Column, level: Column) -> Column:
    """At most eight parts by three bits, in the order of those bits."""
    return let(_mask(level, 7), lambda mask: F.transform(
        F.array_sort(F.array_distinct(F.transform(digests, lambda x: x.bitwiseAND(mask)))),
        lambda key: F.filter(digests, lambda x: x.bitwiseAND(mask) == key),
    ))


def _leaf(digests: Column, cells: Column, level: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), digests[0].bitwiseAND(_mask(level, 1) - 1).alias("part"), cells.alias("cells"))


def sketches(digests: Column) -> Column:
    """Parts of a set of digests as (level, part, cells): the part's digests end
    in the ``3 * level`` bits of ``part``. Each sketch peels by itself."""

    def attempt(part: Column, level: Column) -> Column:
        places = F.transform(part, lambda x: x.bitwiseAND(F.lit(_PLACES)))
        peels = (F.size(part) <= PART) & (F.size(F.array_distinct(places)) == F.size(part))
        return F.struct(part.alias("digests"), F.when(peels | (level == RETRIES - 1), sketch(part)).alias("cells"))

    def step(state: Column, level: Column) -> Column:
        return F.when(F.size(state["left"]) == 0, state).otherwise(let(F.transform(state["left"], lambda p: attempt(p, level)), lambda tried: F.struct(
            F.concat(state["leaves"], F.transform(F.filter(tried, lambda t: t["cells"].isNotNull()), lambda t: _leaf(t["digests"], t["cells"], level))).alias("leaves"),
            F.flatten(F.transform(F.filter(tried, lambda t: t["cells"].isNull()), lambda t: _dealt(t["digests"], level))).alias("left"),
        )))

    left = F.filter(F.array(digests), lambda d: F.size(d) > 0)
    start = F.struct(F.array().cast(_LEAVES).alias("leaves"), left.alias("left"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES - 1)), start, step, lambda s: s["leaves"])


def fingerprint(leaves: Column) -> Column:
    """Sketches as text: ``level:part:cells`` joined by ``;``, the cells that
    are not empty as ``place.count.digests.checks`` joined by ``,`` (hex, but
    for the decimal level and count)."""

    def cell(x: Column, i: Column) -> Column:
        return F.when((x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0), F.concat_ws(".", F.hex(i), x["n"].cast("string"), F.hex(x["k"]), F.hex(x["c"])))

    return F.array_join(F.transform(leaves, lambda leaf: F.concat_ws(
        ":", leaf["level"].cast("string"), F.hex(leaf["part"]), F.array_join(F.transform(leaf["cells"], cell), ",")
    )), ";")


def read_fingerprint(text: Column) -> Column:
    """The sketches that ``fingerprint`` wrote."""
    number = lambda digits: F.conv(digits, 16, -10).cast("long")

    def cells(texts: Column) -> Column:
        named = F.map_from_entries(F.transform(texts, lambda t: F.struct(F.split_part(t, F.lit("."), F.lit(1)), F.split(t, r"\."))))
        return let(named, lambda at: F.array(*[let(F.try_element_at(at, F.lit(f"{i:X}")), lambda x: F.struct(
            F.coalesce(x[1].cast("int"), F.lit(0)).alias("n"), F.coalesce(number(x[2]), F.lit(0).cast("long")).alias("k"),
            F.coalesce(number(x[3]), F.lit(0).cast("long")).alias("c"),
        )) for i in range(CELLS)]))

    leaves = F.filter(F.split(text, ";"), lambda t: t != "")
    return F.transform(F.transform(leaves, lambda t: F.split(t, ":")), lambda x: F.struct(
        x[0].cast("int").alias("level"), number(x[1]).alias("part"), cells(F.split(x[2], ",")).alias("cells")
    ))


def held(leaves: Column) -> Column:
    """Number of digests in sketches: each has one cell of the first table."""
    return F.aggregate(leaves, F.lit(0), lambda n, leaf: n + F.aggregate(F.slice(leaf["cells"], 1, SLOTS), F.lit(0), lambda m, x: m + x["n"]))


def differing(a: Column, b: Column) -> Column:
    """Number of digests in one of two fingerprints' sketches only."""

    def undivided(leaves: Column, level: Column) -> Column:
        return (F.size(leaves) == 1) & (leaves[0]["level"] == level)

    def attempt(part: Column, level: Column) -> Column:
        x, y = part["a"], part["b"]
        every = held(x) + held(y)
        d = (
            F.when((F.size(x) == 0) | (F.size(y) == 0), every)
            .when(undivided(x, level) & undivided(y, level), F.when(x[0]["cells"] == y[0]["cells"], F.lit(0))
                  .when(every == 2, every).otherwise(F.coalesce(
                      every - 2 * F.array_size(F.array_intersect(stated(x[0]["cells"]), stated(y[0]["cells"]))),
                      peeled(subtracted(x[0]["cells"], y[0]["cells"])),
                  )))
            .otherwise(F.lit(-1))
        )
        return let(d, lambda n: F.struct(x.alias("a"), y.alias("b"), F.when((n < 0) & (level == RETRIES - 1), every).otherwise(n).alias("d")))

    def digests(leaf: Column) -> Column:
        return F.coalesce(stated(leaf["cells"]), recovered(leaf["cells"]))

    def deeper(leaves: Column, level: Column) -> Column:
        return F.when(undivided(leaves, level), F.transform(
            _dealt(digests(leaves[0]), level), lambda ks: _leaf(ks, sketch(ks), level + 1)
        )).otherwise(leaves)

    def split(part: Column, level: Column) -> Column:
        both = F.struct(deeper(part["a"], level).alias("a"), deeper(part["b"], level).alias("b"), _mask(level, 7).alias("mask"))
        mine = lambda leaves, mask, key: F.filter(leaves, lambda leaf: leaf["part"].bitwiseAND(mask) == key)
        return let(both, lambda at: F.transform(
            F.array_distinct(F.transform(F.concat(at["a"], at["b"]), lambda leaf: leaf["part"].bitwiseAND(at["mask"]))),
            lambda key: F.struct(mine(at["a"], at["mask"], key).alias("a"), mine(at["b"], at["mask"], key).alias("b")),
        ))

    def step(state: Column, level: Column) -> Column:
        return F.when(F.size(state["left"]) == 0, state).otherwise(let(F.transform(state["left"], lambda p: attempt(p, level)), lambda tried: F.struct(
            F.aggregate(tried, state["found"], lambda acc, t: acc + F.greatest(t["d"], F.lit(0))).alias("found"),
            F.flatten(F.transform(F.filter(tried, lambda t: t["d"] < 0), lambda t: split(t, level))).alias("left"),
        )))

    start = F.struct(F.lit(0).alias("found"), F.array(F.struct(a.alias("a"), b.alias("b"))).alias("left"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES - 1)), start, step, lambda s: s["found"])


def likeness(a: Column, b: Column) -> Column:
    """Common paragraphs over all paragraphs of two texts, from their
    fingerprints' sketches."""
    return let(held(a) + held(b), lambda total: F.when(total == 0, F.lit(1.0)).otherwise(
        let(differing(a, b), lambda d: (total - d) / (total + d))
    ))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """``likeness`` of two stored fingerprints."""
    return let(read_fingerprint(a), lambda x: let(read_fingerprint(b), lambda y: likeness(x, y)))


def with_next(rows: DataFrame, *columns: str, made: dict[str, Column] | None = None) -> DataFrame:
    """Rows (did, th, ...) with ``next_<column>`` of the following row by
    (did, th), the first after the last. Columns of ``made`` are made once a
    row after the shuffle and have a ``next_`` too. Ids are dealt to ranges by quantiles,
    an id that fills several (such as null) by its text hashes; the rows that
    begin a range are sent to the range before it as well, so each range finds
    its successors alone."""
    ranges = 4 * shuffle_partitions(rows.sparkSession)
    marks = [i / ranges for i in range(1, ranges)]
    cuts = sorted(rows.agg(F.percentile_approx("did", marks, 100_000)).first()[0] or [])
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    # Hashes are spread evenly: the top 31 bits in as many slices as the id has cuts.
    hashed = F.shiftright("th", 33) + F.lit(1 << 30)
    slices = F.size(F.filter(bounds, lambda c: c == F.col("did")))
    heavy = F.col("did").isin(sorted({c for c in cuts if cuts.count(c) > 1}))
    number = F.size(F.filter(bounds, lambda c: c < F.col("did"))) + F.when(heavy, F.shiftright(hashed * slices, 31).cast("int")).otherwise(F.lit(0))
    dealt = rows.withColumn("range", number if cuts else F.lit(0))
    firsts = [tuple(r) for r in dealt.groupBy("range").agg(F.min(F.struct("did", "th")).alias("k")).select("range", "k.did", "k.th").orderBy("range").collect()]
    made = made or {}
    columns = (*columns, *made)
    if not firsts:
        return rows.withColumns(made).withColumns({f"next_{c}": F.col(c) for c in columns})
    # (did, th) that begins a range -> the range before it, the last's for the first.
    guests = {(did, th): firsts[i - 1][0] for i, (_, did, th) in enumerate(firsts)}
    table = F.create_map(*[x for (did, th), before in guests.items() for x in (F.struct(F.lit(did).cast("long").alias("did"), F.lit(th).cast("long").alias("th")), F.lit(before))])
    starts = [did for _, did, _ in firsts]
    guest = F.when(F.col("did").isin(starts), F.element_at(table, F.struct("did", "th")))
    seats = F.concat(
        F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))),
        F.when(guest.isNotNull(), F.array(F.struct(guest.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<range:int,guest:boolean>>")),
    )
    order = W.partitionBy("range").orderBy("guest", "did", "th")
    seated = dealt.select(*rows.columns, F.explode(seats).alias("seat")).select(*rows.columns, "seat.range", "seat.guest")
    seated = seated.repartition("range").withColumns(made)
    return (
        seated.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
        .where(~F.col("guest")).drop("range", "guest")
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the
    following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for each document."""
    # A text's sketches serve it and the text before it.
    pairs = with_next(keyed(docs), "text", made={"own": sketches(paragraphs(F.col("text")))})
    edits = pairs.withColumn("edited_text", edited_text(F.col("text"), F.col("next_text")))
    ready = edits.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        "own", "next_own", sketches(paragraphs(F.col("edited_text"))).alias("edited"),
    )
    own, following, edited = (F.col(c) for c in ("own", "next_own", "edited"))
    compared = ready.select(
        "doc_id", "n_chars", "edited_sha256", F.transform(F.array(own, edited), fingerprint).alias("prints"),
        F.transform(F.array(edited, following), lambda other: likeness(own, other)).alias("near"),
    )
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", F.col("prints")[0].alias("fingerprint"), F.col("prints")[1].alias("edited_fingerprint"),
        F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir).select("doc_id", "text"))
