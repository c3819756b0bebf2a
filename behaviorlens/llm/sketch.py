"""Document fingerprints by invertible Bloom lookup sketches.

A text is the set of the digests of its pieces: shingles of words (`word_shingles`), or its
paragraphs, which are its lines, long ones in pieces by length. A
digest is a 64-bit word whose low 24 bits check the 40 above them. A sketch is a table of cells; each is the
XOR of the digests that hash to it. Two sketches of the same size subtract by XOR; what both texts
have cancels. A cell that is its own check holds a single digest, most likely, and peeling such
cells recovers the digests in which the texts differ; the difference is known when every cell has
come out as zero.

A fingerprint is blocked: the digests are dealt to blocks by a hash, a power of two of them so that
a block has six at most on average, and each block is a table of its own. It depends on the
text alone, and has the size of the set in front. Two fingerprints are subtracted and peeled block
by block; where the two have unlike numbers of blocks, the smaller set is sketched again with as
many as the larger. A block that does not peel is sketched again with larger and larger tables. There
is no other way to compare: were the largest table to fail too, its digests that came out and the
cells that are left are counted, and the result says so. All of it is built-in functions over arrays
of a row; nothing is exploded.

Of a long text a share of the shingles may do: those whose high bits, a hash of their last two
words, are below a bound that falls with the length. The bound moves smoothly, and what a lower
bound keeps a higher one keeps too, so two texts are compared below the lower of their bounds,
whatever their lengths. Which shingles are kept depends on the words alone, all over the text.

Nothing has to be left out: `word_pieces` ends a piece of the text at each shingle below the bound,
and a piece is the sum of all its shingles, so each word counts. Pieces of one bound are added up to
those of a lower one, by which two texts of any lengths have pieces of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import Scratch, hash_pair, shuffle_partitions, text_of

#: Code points after which a line is cut at the end of the word.
PIECE = 256
#: Words of a shingle.
SHINGLE = 4
#: Code points of a text up to which all its shingles are kept by the registered query; beyond, a share in inverse proportion.
FULL = 256
#: A word: a character of a script without blanks, or as many as 32 of any others but white space.
_ALONE = "\\u0E00-\\u0E7F\\u3040-\\u30FF\\u3400-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
WORD = f"[{_ALONE}]|[^\\s{_ALONE}]{{1,32}}"
#: Cells in each of the three parts of a block's table: at first, and those that are tried in turn where it fails.
BASE, LARGER = 8, (16, 64, 1024)
#: Digests of a text that share a block on average, at most, and rounds of peeling before a table counts as failed.
LOAD, ROUNDS = 6, 5

CHECK_BITS = 24
#: High bits of a digest that bounds are compared with, and those between them and the check.
RANK_BITS, REST_BITS = 20, 20
_LOW = (1 << CHECK_BITS) - 1
_REST = (1 << REST_BITS) - 1 << CHECK_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Lines without line feeds, in pieces of at least PIECE code points that end with a word; empty lines are none."""
    return F.regexp_extract_all(text, F.lit(f"[^\\n]{{{PIECE}}}[^\\n ]*|[^\\n]+"), F.lit(0))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _checked(h: Column) -> Column:
    """The high bits of a hash with their check below them."""
    return let(h.bitwiseAND(_long(~_LOW)), lambda k: k.bitwiseOR(F.xxhash64(F.lit(9), k).bitwiseAND(_long(_LOW))))


def digests(text: Column, below: Column | None = None) -> Column:
    """The distinct paragraphs of a text as an array of digests; all of them, whatever the bound."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: _checked(F.xxhash64(p))))


def word_shingles(text: Column, below: Column | None = None) -> Column:
    """The distinct shingles of SHINGLE words of a text as an array of digests, of those whose rank is below a bound.

    The first shingles are shorter: one ends with every word. White space between words doesn't count.
    """
    rank, rest = _long(-(1 << 64 - RANK_BITS)), _long(_REST)

    def of(words: Column, below: Column) -> Column:
        def digest(w: Column, i: Column) -> Column:
            last_two = F.xxhash64(w, F.get(words, i - 1))
            whole = F.xxhash64(F.slice(words, F.greatest(i - (SHINGLE - 2), F.lit(1)), F.least(i + 1, F.lit(SHINGLE))))
            return F.when(F.shiftrightunsigned(last_two, 64 - RANK_BITS) < below, _checked(last_two.bitwiseAND(rank).bitwiseOR(whole.bitwiseAND(rest))))

        return F.transform(words, digest)

    hashed = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    every = _long(1 << RANK_BITS) if below is None else below
    return F.array_distinct(F.array_compact(let(hashed, lambda words: let(every, lambda b: of(words, b)))))


def word_pieces(text: Column, below: Column | None = None) -> Column:
    """The whole text as an array of pieces, in order and with repeats: each ends with a shingle whose rank is below a bound, or with the text.

    A piece has the rank of its last shingle and the sum of the other hashes of all its shingles, and no check yet.
    """
    rank, rest = _long(-(1 << 64 - RANK_BITS)), _long(_REST)

    def of(words: Column) -> Column:
        def shingle(w: Column, i: Column) -> Column:
            before = [F.get(words, i - k) for k in range(1, SHINGLE)]
            return F.xxhash64(w, before[0]).bitwiseAND(rank).bitwiseOR(F.xxhash64(w, *before).bitwiseAND(rest))

        return F.transform(words, shingle)

    hashed = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return merged(let(hashed, of), _long(1 << RANK_BITS) if below is None else below)


def merged(pieces: Column, below: Column) -> Column:
    """Pieces, or single shingles, added up to those of a lower bound."""
    rest = _long(_REST)

    def cut_up(p: Column, b: Column) -> Column:
        def piece(end: Column, start: Column) -> Column:
            total = F.aggregate(F.slice(p, start + 1, end - start), _long(0), lambda n, x: (n + x.bitwiseAND(rest)).bitwiseAND(rest))
            return F.get(p, end - 1).bitwiseAND(_long(-(1 << 64 - RANK_BITS))).bitwiseOR(total)

        is_end = lambda x, i: (F.shiftrightunsigned(x, 64 - RANK_BITS) < b) | (i + 1 == F.size(p))
        ends = F.array_compact(F.transform(p, lambda x, i: F.when(is_end(x, i), i + 1)))
        return let(ends, lambda e: F.transform(e, lambda end, k: piece(end, F.coalesce(F.get(e, k - 1), F.lit(0)))))

    return let(pieces, lambda p: let(below, lambda b: cut_up(p, b)))


def set_of(pieces: Column) -> Column:
    """The distinct pieces as digests."""
    return F.array_distinct(F.transform(pieces, _checked))


def bound(n_chars: Column, full: int | None) -> Column:
    """What the rank of a digest is below, of a text so long; `full` code points have all ranks, as has every text without it."""
    every = _long(1 << RANK_BITS)
    return every if full is None else F.when(n_chars <= full, every).otherwise(F.greatest(_long(1), F.floor(F.lit(float(full << RANK_BITS)) / n_chars)))


def sampled(of: Column, below: Column) -> Column:
    """The digests whose rank is below a bound."""
    return F.filter(of, lambda d: F.shiftrightunsigned(d, 64 - RANK_BITS) < below)


def blocks_of(digests: Column) -> Column:
    """How many blocks the fingerprint of a set has: the power of two that leaves LOAD digests in each, at most."""
    return let(F.greatest(F.lit(1.0), F.size(digests) / LOAD), lambda n: F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(n)).cast("int")))


def _cells(size: int) -> Column:
    """Of each cell of a table, the bits of a digest that name a place in its part and what they must be."""

    def cell(i: Column) -> Column:
        shift = (F.floor(i / size) * 12 + CHECK_BITS).cast("int")
        return F.struct(*[F.call_function("shiftleft", x.cast("long"), shift).alias(name) for x, name in ((F.lit(size - 1), "bits"), (i % size, "place"))])

    return F.transform(F.sequence(F.lit(0), F.lit(3 * size - 1)), cell)


def _xor_into(start: Column, found: Column, cell: Column) -> Column:
    """`start` XOR the digests of a set that hash to a cell."""
    return F.aggregate(found, start, lambda a, d: F.call_function("if", d.bitwiseAND(cell["bits"]) == cell["place"], a.bitwiseXOR(d), a))


def dealt(of: Column, blocks: Column) -> Column:
    """The digests of each block, in the order of the blocks, by one sort; each block has a 0 besides, which changes no cell."""
    own = F.transform(of, lambda d: F.struct(F.xxhash64(F.lit(11), d).bitwiseAND(blocks.cast("long") - 1).alias("block"), d.alias("d")))
    marks = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda g: F.struct(g.cast("long").alias("block"), _long(0).alias("d")))

    def cut_up(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1)["block"] != F.get(s, i)["block"]))
        return let(last, lambda ends: F.transform(ends, lambda e, k: let(F.coalesce(F.get(ends, k - 1), F.lit(0)), lambda b: F.transform(F.slice(s, b + 1, e - b), lambda x: x["d"]))))

    return let(F.sort_array(F.concat(own, marks)), cut_up)


def table(of: Column, cells: Column) -> Column:
    """The cells of one table of a set of digests."""
    return F.transform(cells, lambda cell: _xor_into(_long(0), of, cell))


def sketch(of: Column, blocks: Column) -> Column:
    """The tables of all blocks of a set of digests."""
    return let(_cells(BASE), lambda cells: F.transform(dealt(of, blocks), lambda own: table(own, cells)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peel(cells: Column, places: Column) -> Column:
    """`found`, the digests in a difference, of either side, and `left`, the cells that aren't zero after peeling.

    A cell that is zero holds nothing any more, so only the others are gone through.
    """

    def pure(cells: Column) -> Column:
        return F.array_distinct(F.filter(cells, lambda x: (x != 0) & (F.xxhash64(F.lit(9), x.bitwiseAND(_long(~_LOW))).bitwiseAND(_long(_LOW)) == x.bitwiseAND(_long(_LOW)))))

    def step(state: Column, _: Column) -> Column:
        def after(found: Column) -> Column:
            rest = F.zip_with(state["cells"], places, lambda x, cell: F.when(x == 0, x).otherwise(_xor_into(x, found, cell)))
            return F.when(F.size(found) == 0, state).otherwise(F.struct(rest.alias("cells"), F.concat(state["found"], found).alias("found")))

        return F.when(F.exists(state["cells"], lambda x: x != 0), let(pure(state["cells"]), after)).otherwise(state)

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.struct(s["found"].alias("found"), F.size(F.filter(s["cells"], lambda x: x != 0)).alias("left"))
    )


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """`found`, the digests in which two sets differ, and `left`, cells that never peeled, from their sketches of base size."""
    blocks = F.greatest(F.size(sketch_a), F.size(sketch_b))

    def compare(s: Column) -> Column:
        peeled = let(_cells(BASE), lambda places: F.zip_with(s["x"], s["y"], lambda x, y: peel(subtract(x, y), places)))
        return let(peeled, lambda p: F.when(F.exists(p, lambda r: r["left"] > 0), let(F.struct(dealt(a, s["n"]).alias("x"), dealt(b, s["n"]).alias("y")), lambda d: again(p, d))).otherwise(p))

    def again(peeled: Column, digests: Column) -> Column:
        """The blocks that failed, sketched and peeled once more, larger."""
        def larger(r: Column, k: Column, sizes: tuple[int, ...]) -> Column:
            if not sizes:
                return r
            size = sizes[0]
            both = F.concat(F.get(digests["x"], k), F.get(digests["y"], k))  # the XOR of two tables is that of both sets' digests
            more = let(_cells(size), lambda places: peel(table(both, places), places))
            return F.when(r["left"] == 0, r).otherwise(let(more, lambda m: larger(m, k, sizes[1:])))

        return F.transform(peeled, lambda r, k: larger(r, k, LARGER))

    same = F.struct(
        blocks.alias("n"),
        F.when(F.size(sketch_a) == blocks, sketch_a).otherwise(sketch(a, blocks)).alias("x"),
        F.when(F.size(sketch_b) == blocks, sketch_b).otherwise(sketch(b, blocks)).alias("y"),
    )
    return let(let(same, compare), lambda p: F.struct(F.flatten(F.transform(p, lambda r: r["found"])).alias("found"), F.aggregate(p, F.lit(0), lambda n, r: n + r["left"]).alias("left")))


def fingerprint(of: Column) -> Column:
    """The size of a set of digests and its sketch as a string of hexadecimal digits."""
    cells = F.transform(F.flatten(sketch(of, blocks_of(of))), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.concat(F.lpad(F.hex(F.size(of)), 8, "0"), F.array_join(cells, ""))


def likeness(a: Column, b: Column, differing: Column, below: Column) -> Column:
    """Shared digests below a bound as a part of all: both sizes are known, and the sketches tell how many differ; 1 for two empty sets."""

    def of(below: Column) -> Column:
        n, d = F.size(sampled(a, below)) + F.size(sampled(b, below)), F.size(sampled(differing["found"], below)) + differing["left"]
        return F.greatest(F.lit(0.0), F.coalesce((n - d) / F.nullif(n + d, F.lit(0)), F.lit(1.0)).cast("double"))

    return let(below, of)


def _neighbours(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """For each distinct row: x1, x2, xn, hashes and length of the row after it by ascending id; after the last, the first.

    Rows are range-partitioned, each looks ahead inside its partition, and the first rows of the
    partitions, as many as those, are the only ones that are looked at together.
    """
    n = shuffle_partitions(ids.sparkSession)
    ranged = scratch.cut(ids.repartitionByRange(n, "doc_id", "r1", "r2").withColumn("bucket", F.spark_partition_id()))
    me = F.struct("doc_id", "r1", "r2", "n")
    heads = ranged.groupBy("bucket").agg(F.min(me).alias("head"))
    order = Window.orderBy("bucket")
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    after = F.lead(me).over(Window.partitionBy("bucket").orderBy("doc_id", "r1", "r2"))
    out = ranged.withColumn("after", after).join(heads, "bucket").withColumn("x", F.coalesce("after", "beyond"))
    return out.select("r1", "r2", F.col("x.r1").alias("x1"), F.col("x.r2").alias("x2"), F.col("x.n").alias("xn"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: Callable[[Column, Column], Column] = digests, full: int | None = None, pieces: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last third of the code points replaced by the first as many of the
    next document, by descending id, or by all of it if it is shorter; the document after the last
    is the first. One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_edits (differing digests of the edit), next_id,
    peeled (whether both differences are exact). `digests` makes the set of a text below a bound:
    of its paragraphs, or `word_shingles`; `full` is as in `bound`. With `pieces` it makes arrays
    like those of `word_pieces`, which are compared `merged` below the lower bound of both texts. All but the
    fingerprints, which are made from written digests, is a written table.

    Null texts are empty, and an empty text has no piece. Null ids come last by
    descending id; rows that share an id follow a hash of their text; fully repeated rows are one
    document and each has its row. A single document is its own neighbour. An empty table gives no
    rows; other columns are ignored.
    """
    hashes = [h.alias(x) for h, x in zip(hash_pair(7, F.col(id_col), text_of(text_col)), ("r1", "r2"))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *hashes, text_of(text_col).alias("text")).withColumn("n", F.char_length("text").cast("long"))
    rows = rows.withColumn("own", digests(F.col("text"), bound(F.col("n"), full)))
    ids = rows.select("doc_id", "r1", "r2", "n")
    with Scratch(docs.sparkSession) as scratch:
        distinct = scratch.cut(ids.distinct())
        repeated = distinct.count() < docs.count()
        after = scratch.cut(_neighbours(distinct, scratch))
        found = scratch.cut(_compared(rows.join(after, ["r1", "r2"]), repeated, digests, full, pieces))
        scratch.keep(found)
    # The digests are written and not their sketches, which are several times as large.
    prints = {"a": "fingerprint", "e": "edited_fingerprint"}
    return found.select("doc_id", "n_chars", "edited_sha256", *[fingerprint(F.col(k)).alias(n) for k, n in prints.items()], "near_edited", "near_next", "n_edits", "next_id", "peeled")


def _compared(placed: DataFrame, repeated: bool, digests: Callable[[Column, Column], Column], full: int | None, pieces: bool) -> DataFrame:
    # From each document to the one that it follows: as much of its text as is asked for, and its digests.
    tail = F.substring("text", F.lit(1), F.floor(F.col("xn") / 3).cast("int"))
    given = placed.select("x1", "x2", F.col("doc_id").alias("next_id"), F.col("n").alias("next_chars"), tail.alias("tail"), F.col("own").alias("x"))
    if repeated:
        given = given.dropDuplicates(["x1", "x2"])
    both = placed.join(given.withColumnsRenamed({"x1": "r1", "x2": "r2"}), ["r1", "r2"])
    head = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int"))
    both = both.select("doc_id", "next_id", F.col("n").alias("n_chars"), "next_chars", F.col("own").alias("a"), "x", F.concat(head, F.col("tail")).alias("edited"))
    both = both.withColumn("edited_chars", F.char_length("edited").cast("long"))
    both = both.select(
        "doc_id", "next_id", "n_chars", "edited_chars", "next_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "a", digests(F.col("edited"), bound(F.col("edited_chars"), full)).alias("e"), "x",
    )
    own = {"a": bound(F.col("n_chars"), full), "e": bound(F.col("edited_chars"), full), "x": bound(F.col("next_chars"), full)}
    below = {k: F.least(own["a"], own[k]) for k in "ex"}
    if pieces:
        # Both sides of a comparison have the pieces of the lower bound; `a` itself is sketched once where that is its own.
        def at(k: str, b: Column) -> Column:
            return set_of(F.when(own[k] == b, F.col(k)).otherwise(merged(F.col(k), b)))

        both = both.withColumns({"qa": set_of(F.col("a")), "qe": set_of(F.col("e")), **{f"q{k}2": at(k, below[k]) for k in "ex"}})
        both = both.withColumns({f"a{k}": F.when(own["a"] == below[k], F.col("qa")).otherwise(at("a", below[k])) for k in "ex"})
        both = both.withColumn("sa", sketch(F.col("qa"), blocks_of(F.col("qa"))))
        both = both.withColumns({f"s{k}": sketch(F.col(f"q{k}2"), blocks_of(F.col(f"q{k}2"))) for k in "ex"})
        both = both.withColumns({f"sa{k}": F.when(own["a"] == below[k], F.col("sa")).otherwise(sketch(F.col(f"a{k}"), blocks_of(F.col(f"a{k}")))) for k in "ex"})
        sides = {k: [F.col(f"a{k}"), F.col(f"q{k}2"), F.col(f"sa{k}"), F.col(f"s{k}")] for k in "ex"}
        below = dict.fromkeys("ex", _long(1 << RANK_BITS))
        prints = [F.col("qa").alias("a"), F.col("qe").alias("e")]
    else:
        both = both.withColumns({f"s{k}": sketch(F.col(k), blocks_of(F.col(k))) for k in "aex"})
        sides = {k: [F.col("a"), F.col(k), F.col("sa"), F.col(f"s{k}")] for k in "ex"}
        prints = [F.col("a"), F.col("e")]
    both = both.withColumns({f"d{k}": difference(*sides[k]) for k in "ex"})
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        *prints,
        likeness(*sides["e"][:2], F.col("de"), below["e"]).alias("near_edited"),
        likeness(*sides["x"][:2], F.col("dx"), below["x"]).alias("near_next"),
        F.size("de.found").cast("long").alias("n_edits"),
        "next_id",
        ((F.col("de.left") == 0) & (F.col("dx.left") == 0)).alias("peeled"),
    )
