"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines that occur before (in the order of document id and line number) go, and
so do lines within max_edits edits of an earlier line. A pair within k edits,
of which one line is cut into k + 1 segments, has a segment without edits at a
place that is shifted by few characters (the multi-match-aware selection of
Pass-Join, Li et al., 2011). Lines of near lengths form a class with segments of
one size, the first from the line's start on, the last up to its end; so one
key for each end serves as index and probe of the whole class, only the
segments between are probed with shifts, and only a line whose shorter partners
lie in the class below probes that, too. Lines that share a key, and have
nearly the same letters, are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Lines that one side of a key brings to one task; those of larger keys are dealt into blocks that all meet.
KEY_ROWS = 1024
#: Lines with more than this part of all occurrences are common; there are fewer than it says.
COMMON = 4096


def class_floor(n: Column) -> Column:
    """The least length of the class of length n: its leading three bits. Classes of lengths from 16 on are at least 4 wide."""
    shift = F.greatest(F.length(F.bin(n)) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n.cast("int"), shift), shift)


def segment_keys(lines: DataFrame, edits: int, min_length: int) -> DataFrame:
    """lines (line and its length n among them) with key and index of each segment; index is 1 where it is the line's own, 0 where it only probes.

    A key names the segment's number, the class and the text. less: how many
    characters shorter a partner in the index is; a class is probed from the
    first such number on that leads to it. Lines have min_length characters at least.
    """
    parts = edits + 1
    floors = {f"__floor_{less}": class_floor(F.col("n") - less) for less in range(parts)}
    rows = []
    for less in range(parts):
        floor = F.col(f"__floor_{less}")
        size = F.col(f"__size_{less}")
        new = F.lit(True) if less == 0 else (floor != F.col(f"__floor_{less - 1}")) & (F.col("n") - less >= max(1, min_length))
        for i in range(parts):
            last = i == edits
            # after i segments at most i edits are left of it and edits - i right of it
            shifts = [0] if i == 0 or last else range(max(-i, less - (edits - i)), i + 1)
            for shift in shifts:
                start = F.col("n") - size + 1 if last and i else size * i + (1 + shift)
                key = F.xxhash64(F.lit(i), floor, F.substring("line", start, size))
                rows.append(F.when(new, F.struct(key.alias("key"), F.lit(int(less == 0 and shift == 0)).alias("index"))))
    sized = lines.withColumns(floors).withColumns({f"__size_{less}": F.expr(f"__floor_{less} div {parts}").cast("int") for less in range(parts)})
    return sized.select(*lines.columns, F.explode(F.array(*rows)).alias("k")).where("k is not null").select(*lines.columns, "k.key", "k.index")


#: Letters are counted in these groups to tell lines apart before they are aligned; all others are counted together.
COUNTED = (" ", "ea", "it", "on", "srl", "hdcu", "mpfgwybv")


def letter_counts(line: Column, length: Column) -> list[Column]:
    """How many letters of each group a line has: an edit changes two of these (and the length) by one at most."""
    return [(length - F.length(F.translate(line, c, ""))).alias(f"c{k}") for k, c in enumerate(COUNTED)]


def _common(a: Column, b: Column, room: Column, end: bool) -> Column:
    """Length, up to room and 1023, of the common start (or end) of two strings: by halving steps."""
    steps = F.array(*[F.lit(1 << s) for s in range(9, -1, -1)])

    def further(done: Column, step: Column) -> Column:
        at = -(done + step) if end else done + 1
        same = F.substring(a, at, step) == F.substring(b, at, step)
        return F.when((done + step <= room) & same, done + step).otherwise(done)

    return F.aggregate(steps, F.lit(0), further)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """True if at most edits insertions, deletions and substitutions turn b into a; a is not the shorter one.

    What both start and end with is taken off first. Then the columns of the
    distance matrix are worked off one character of b at a time: bits of one
    word hold the vertical differences (vp: +1, vn: -1) in a band of edits rows
    to either side, and the distance on the diagonal of the last cell goes up by
    one where the diagonal bit d0 is off. It never goes down, so the characters
    are taken in pieces and the later ones only while it is small enough.
    """
    shorter = F.least(F.length(a), F.length(b))
    start = _common(a, b, shorter, end=False)
    tail = _common(a, b, shorter - start, end=True)
    pair = F.struct(F.length(a).alias("m"), F.length(b).alias("n"), start.alias("start"), tail.alias("tail"))

    def verdict(cuts: Column) -> Column:
        m, n = cuts["m"] - cuts["start"] - cuts["tail"], cuts["n"] - cuts["start"] - cuts["tail"]
        rows = F.split(F.substring(a, cuts["start"] + 1, m), "")
        columns = F.split(F.substring(b, cuts["start"] + 1, n), "")
        parts = F.struct(m.alias("m"), n.alias("n"), rows.alias("rows"), columns.alias("columns"))
        return F.element_at(F.transform(F.array(parts), lambda p: _banded(p, edits)), 1)

    # transform over an array of one: what the lambda takes is computed once
    return F.element_at(F.transform(F.array(pair), verdict), 1)


def _further(todo: Column, step: Callable[[Column, Column], Column], edits: int) -> Callable[[Column], Column]:
    return lambda state: F.when(state["miss"] > edits, state).otherwise(F.aggregate(todo, state, step))


def _banded(p: Column, edits: int) -> Column:
    width = 2 * edits + 1
    full = (1 << width) - 1
    diagonal = F.get(F.array(*[F.lit(1 << bit) for bit in range(width)]), (p["m"] - p["n"] + edits).cast("int"))

    def step(state: Column, j: Column) -> Column:
        letter = F.get(p["columns"], j - 1)
        match = F.lit(0)
        for bit in range(width):
            # outside the line get() is null and nothing matches
            match = match + F.when(F.get(p["rows"], j + (bit - edits - 1)) == letter, 1 << bit).otherwise(0)
        vp, vn = state["vp"], state["vn"]
        eq = F.struct(match.alias("x"))

        def update(e: Column) -> Column:
            x = e["x"].bitwiseOR(vn)
            d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseAND(full)
            return F.struct(d0.alias("d0"))

        def after(d: Column) -> Column:
            d0 = d["d0"]
            hn = vp.bitwiseAND(d0)
            hp = vn.bitwiseOR(F.bitwise_not(vp.bitwiseOR(d0)).bitwiseAND(full))
            down = F.shiftright(d0, 1)
            missed = F.when(d0.bitwiseAND(diagonal) != 0, 0).otherwise(1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (state["miss"] + missed).alias("miss"),
            )

        return F.element_at(F.transform(F.transform(F.array(eq), update), after), 1)

    # the band of the first column holds rows 1 - edits to 1 + edits: below row 0 the distance grows by one a row
    first = sum(1 << bit for bit in range(edits, width))
    start = F.struct(F.lit(first).alias("vp"), F.lit(0).alias("vn"), (p["m"] - p["n"]).cast("int").alias("miss"))
    state, done = start, 0
    for upto in (32, None):
        last = p["n"] if upto is None else F.least(p["n"], F.lit(upto))
        todo = F.when((last > done), F.sequence(F.lit(done + 1), F.greatest(last, F.lit(done + 1)))).otherwise(F.array().cast("array<int>"))
        state = F.element_at(F.transform(F.array(state), _further(todo, step, edits)), 1)
        done = upto
    return state["miss"] <= edits


def _row_name(row: Column, docs: DataFrame) -> Column:
    """A hash of all columns of a row (but maps, which have none): equal rows have one name."""
    return F.xxhash64(*[row[f.name] for f in docs.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString()])


def _lines_at(base: DataFrame, places: DataFrame, carried: str, id_col: str, text_col: str) -> DataFrame:
    """name, id, line and the fields of carried (pos among them) of the lines at places.

    places: name and the struct carried; base (row and name) is dealt by name
    and is not moved.
    """
    wanted = places.groupBy("name").agg(F.collect_list(carried).alias("wanted"))
    row = F.col("row")
    # the whole row is asked for by every branch, so that all read the same exchange
    text = F.when(_row_name(row, base) == F.col("name"), row[text_col])
    parts = F.struct(F.split(text, "\n").alias("lines"), F.col("wanted"))

    def taken(p: Column) -> Column:
        return F.transform(p["wanted"], lambda w: F.struct(w.alias("w"), F.get(p["lines"], w["pos"]).alias("line")))

    # transform over an array of one: the text is split once
    found = base.join(wanted, "name").select("name", row[id_col].alias("id"), F.explode(F.element_at(F.transform(F.array(parts), taken), 1)).alias("x"))
    return found.where("x.line is not null").select("name", "id", "x.w.*", "x.line")


def _place(prefix: str) -> Column:
    """Order of the documents' lines: by id (null first), line number and the document's name."""
    return F.struct(*[F.col(f"{prefix}{c}") for c in ("id", "pos", "name")])


def near_lines(base: DataFrame, first: DataFrame, edits: int, min_length: int, id_col: str, text_col: str) -> DataFrame:
    """name, pos and hash h of those of the distinct lines' first places that an earlier line is near to; first: these places, base: the rows, dealt by name.

    A line that is near an earlier one goes by one such partner (half join): no
    list of all is made. Where more than KEY_ROWS lines share a key, the lines
    that may go are copied to blocks of their possible partners.
    """
    # a row to shuffle is three numbers: key, document, and line number with its last bit for "in the index"
    keyed = (
        _lines_at(base, first.select("name", F.struct("pos").alias("p")), "p", id_col, text_col)
        .select("name", "pos", "line", F.length("line").alias("n"))
        .where(F.col("n") >= min_length)
        .transform(segment_keys, edits, min_length)
        .select("key", "name", (F.col("pos").cast("long") * 2 + F.col("index")).alias("at"))
    )
    by_key = Window.partitionBy("key")
    over = {
        "one": F.min("name").over(by_key) < F.max("name").over(by_key),
        "two": F.min(F.shiftright("at", 1)).over(by_key) < F.max(F.shiftright("at", 1)).over(by_key),
        "indexed": F.max(F.col("at").bitwiseAND(1)).over(by_key) == 1,
        "rows": F.count("*").over(by_key),
    }
    carried = F.struct(
        F.shiftright("at", 1).cast("int").alias("pos"), "key", F.col("at").bitwiseAND(1).cast("int").alias("index"), F.ceil(F.col("rows") / KEY_ROWS).cast("int").alias("blocks")
    )
    shared = keyed.select("*", *[c.alias(n) for n, c in over.items()]).where("indexed and (one or two)").select("name", carried.alias("p"))
    texts = _lines_at(base, shared, "p", id_col, text_col).withColumn("n", F.length("line"))
    counts = letter_counts(F.col("line"), F.col("n"))
    texts = texts.select("*", *counts)
    left = texts.select(*[F.col(c).alias(f"l_{c}") for c in texts.columns if c != "blocks"], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("l_block"))
    right = texts.select(*[F.col(c).alias(f"r_{c}") for c in texts.columns if c != "blocks"], F.pmod(F.xxhash64("name", "pos"), F.col("blocks")).cast("int").alias("r_block"))
    less = F.col("l_n") - F.col("r_n")
    apart = [F.col(f"l_c{k}") - F.col(f"r_c{k}") for k in range(len(counts))]
    changed = sum((F.abs(d) for d in apart), F.abs(less - sum(apart[1:], apart[0])))
    longer, shorter = (F.when(less >= 0, F.col(f"{a}_line")).otherwise(F.col(f"{b}_line")) for a, b in (("l", "r"), ("r", "l")))
    alike = (
        (F.col("l_key") == F.col("r_key"))
        & (F.col("l_block") == F.col("r_block"))
        & (F.col("l_index") + F.col("r_index") > 0)
        & (F.abs(less) <= edits)
        & (changed <= 2 * edits)
        & (_place("r_") < _place("l_"))
        & within_edits(longer, shorter, edits)
    )
    gone = left.join(right, alike, "left_semi")
    return gone.select(F.col("l_name").alias("name"), F.col("l_pos").alias("pos"), F.xxhash64("l_line").alias("h")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_length: int = 20) -> DataFrame:
    """docs with the text of each row cut down to the lines that stay, and n_lines, n_exact and n_near.

    Lines are what \\n parts; blank ones (spaces only) always stay. n_lines counts
    the others, n_exact those gone as equal to an earlier line, n_near those gone
    as within edits edits of an earlier one (first places count; lines of under
    min_length characters go only as equal). Earlier: by id, null first, then by
    line number, then (rows of one id) by a hash of the row. Rows that are equal
    in all columns count as one document and keep the same lines. Null text stays
    null, a text of which no line stays is empty. Extra columns stay as they are;
    one named n_lines, n_exact or n_near gives way to the result's. No rows: no
    rows.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    named = named.select("row", _row_name(F.col("row"), named).alias("name"))
    row = F.col("row")
    lines = (
        named.select("name", row[id_col].alias("id"), F.posexplode(F.split(row[text_col], "\n")).alias("pos", "line"))
        .where(F.trim("line") != "")
        # two hashes name a line
        .select("name", "id", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    )
    lines = materialise(lines, "lines")
    # null ids come first, as in any order of structs
    first = lines.groupBy("h", "g").agg(F.min(F.struct("id", "pos", "name")).alias("f"), F.count("*").alias("times"))
    first = materialise(first.select("h", "g", "f.pos", "f.name", "times"), "first-lines")
    total = first.agg(F.sum("times")).first()[0] or 0

    # the texts are moved once, to their names, and read there for keys, for candidates and for the result
    dealt = named.repartition("name")
    near = near_lines(dealt, first, edits, min_length, id_col, text_col).select("name", "pos", "h", F.lit(False).alias("again"))
    repeated = first.where("times > 1").select("h", "g", F.col("name").alias("first_name"), F.col("pos").alias("first_pos"), "times")
    # fewer than COMMON lines can have so large a part of all: their occurrences are found without a shuffle
    often = F.broadcast(repeated.where(F.col("times") > total / COMMON).drop("times"))
    usual = lines.join(often, ["h", "g"], "left_anti").join(repeated.where(F.col("times") <= total / COMMON).drop("times"), ["h", "g"])
    again = lines.join(often, ["h", "g"]).unionByName(usual).where("name <> first_name or pos <> first_pos")
    gone = (
        again.select("name", "pos", "h", F.lit(True).alias("again"))
        .union(near)
        .groupBy("name")
        # a set: copies of a row have one name, and each of their places goes once
        .agg(F.collect_set(F.struct("pos", "h", "again")).alias("gone"))
    )

    def kept(p: Column) -> Column:
        """Of (lines, gone places in order): the runs of lines between them."""
        none = F.array().cast("array<int>")
        ends = F.coalesce(p["gone"]["pos"], none)
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
        ends = F.concat(ends, F.array(F.size(p["lines"])))
        runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice(p["lines"], r["a"] + 1, r["b"] - r["a"]))
        text = F.when(p["lines"].isNotNull(), F.array_join(F.flatten(runs), "\n"))
        full = F.size(F.filter(p["lines"], lambda x: F.trim(x) != ""))
        exact = F.size(F.filter(p["gone"], lambda x: x["again"]))
        counts = {"n_lines": full, "n_exact": exact, "n_near": F.size(p["gone"]) - exact}
        return F.struct(text.alias("text"), *[F.when(p["lines"].isNull() | (c < 0), 0).otherwise(c).cast("long").alias(n) for n, c in counts.items()])

    def checked(p: Column) -> Column:
        """The gone places of the row's own lines, in order: rows of one name can differ, if hardly ever."""
        own = F.array_sort(F.filter(p["gone"], lambda x: F.xxhash64(F.get(p["lines"], x["pos"])) == x["h"]))
        return F.struct(p["lines"].alias("lines"), F.coalesce(own, F.array().cast("array<struct<pos:int,h:bigint,again:boolean>>")).alias("gone"))

    parts = F.struct(F.split(row[text_col], "\n").alias("lines"), F.col("gone"))
    cut = dealt.join(gone, "name", "left").select("row", F.element_at(F.transform(F.transform(F.array(parts), checked), kept), 1).alias("cut"))
    return cut.select(*[(F.col("cut.text") if c == text_col else row[c]).alias(c) for c in columns], "cut.n_lines", "cut.n_exact", "cut.n_near")
