"""Document fingerprints by winnowing: of the rolling hashes of GRAM units, the least of each window of WINDOW is kept with its position.

A unit is a word, or 16 code points of a longer run without white space. A unit's code is the first 40 bits of its MD5; a gram's hash
is the polynomial of its codes modulo PRIME, so each gram takes four codes and no text. In a window the least hash is chosen, the
rightmost of equal ones, and one that is chosen again is kept once. Two texts that share GRAM + WINDOW - 1 units in a row
therefore share a kept hash, at the same place of the passage; a hash that occurs in no run of GRAM units of both is never shared.

Everything is DataFrame functions: minima of windows are found by doubling (the least of two, four, eight, ...), a few passes over
the array whatever the window. Texts are shuffled once by a digest of the row; what a row needs of the next document (a beginning
and kept hashes) is shuffled beside it. The order of documents is found over ids and lengths alone.

Defined cases: a null text is empty; a text without units has an empty fingerprint, and two of those have likeness 1; fewer units
than a gram are one gram, filled up with zeros; fewer grams than a window are one window; texts of any length are read whole (of equal
hashes on two sides of a multiple of 2^23 grams the left one is taken); null ids come first in the order; rows that repeat an id are
ordered by their content, and of rows that repeat altogether each but one is followed by its like; after the last document comes
the first, which may be itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.quality import let
from quire.llm.workspace import materialise, placed

GRAM, WINDOW = 4, 12
UNIT = "[^\\x20\\x09-\\x0D]{1,16}"
#: The largest prime below 2^40, and a base whose cube leaves room for a code in 62 bits.
PRIME, BASE = 1099511627689, 127
HEX = 10
#: The place of a gram stands below its hash, later places lower, so that the least number is the rightmost least hash.
PLACES = 1 << 23


def _codes(units: Column) -> Column:
    codes = F.transform(units, lambda u: F.conv(F.substring(F.md5(u.cast("binary")), 1, HEX), 16, 10).cast("long"))
    missing = F.greatest(F.lit(0), GRAM - F.size(units))
    return F.when((F.size(units) > 0) & (missing > 0), F.concat(codes, F.array_repeat(F.lit(0).cast("long"), missing))).otherwise(codes)


def _grams(codes: Column) -> Column:
    """Hash and place of every run of GRAM codes, as one number."""

    def gram(i: Column) -> Column:
        terms = [codes[i + t] * (BASE ** (GRAM - 1 - t)) for t in range(GRAM)]
        return (sum(terms[1:], terms[0]) % PRIME) * PLACES + (PLACES - 1 - i % PLACES)

    return F.transform(F.sequence(F.lit(0), F.size(codes) - GRAM), gram)


def _minima(values: Column, width: int) -> Column:
    """The least of every ``width`` neighbours."""

    def least(x: Column, step: int) -> Column:
        return let(x, lambda own: F.transform(F.sequence(F.lit(0), F.size(own) - 1 - step), lambda i: F.least(own[i], own[i + step])))

    reach = 1
    while 2 * reach <= width:
        values, reach = least(values, reach), 2 * reach
    return least(values, width - reach) if reach < width else values


def winnow(text: Column) -> Column:
    """hashes and positions (in grams, from 0) of the kept grams of a text, in their order."""
    none = F.array().cast("array<long>")

    def chosen(minima: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(minima) - 1), lambda i: (i == 0) | (minima[i] != minima[F.greatest(i - 1, F.lit(0))]))

        def kept(at: Column) -> Column:
            place = F.transform(at, lambda i: i + F.pmod(PLACES - 1 - minima[i] % PLACES - i, F.lit(PLACES)))
            return F.struct(F.transform(at, lambda i: F.shiftright(minima[i], 23)).alias("hashes"), place.cast("array<long>").alias("positions"))

        return let(new, kept)

    def windows(grams: Column) -> Column:
        return F.when(F.size(grams) < WINDOW, F.array(F.array_min(grams))).otherwise(_minima(grams, WINDOW))

    def of_codes(codes: Column) -> Column:
        return F.when(F.size(codes) == 0, F.struct(none.alias("hashes"), none.alias("positions"))).otherwise(let(let(_grams(codes), windows), chosen))

    return let(let(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), _codes), of_codes)


def as_text(hashes: Column) -> Column:
    """The kept hashes in order, in hexadecimal digits with blanks between."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), HEX, "0")), " ")


def likeness(one: Column, two: Column) -> Column:
    """Shared of all distinct kept hashes, 0 to 1; two empty fingerprints are alike."""

    def shared(s: Column) -> Column:
        all_ = s["a"] + s["b"] - s["both"]
        return F.when(all_ == 0, F.lit(1.0)).otherwise(s["both"].cast("double") / all_)

    sizes = F.struct(F.size(F.array_distinct(one)).alias("a"), F.size(F.array_distinct(two)).alias("b"), F.size(F.array_intersect(one, two)).alias("both"))
    return let(sizes, shared)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, hashes, positions of every document: one scan, no shuffle."""
    made = docs.select("doc_id", F.inline(F.array(winnow(F.coalesce(F.col("text"), F.lit(""))))))
    return made.select("doc_id", as_text(F.col("hashes")).alias("fingerprint"), "hashes", "positions")


def _followers(rows: DataFrame) -> DataFrame:
    """key, before, wanted: for each distinct row, the key of the one that it follows and how much of its text that one takes."""
    own = rows.groupBy("key", "doc_id").agg(F.first("n_chars").alias("n_chars"))
    line = materialise(placed(own, [F.asc_nulls_first("doc_id"), F.asc("key")], "fingerprints-order").select("key", "n_chars", "place"), "fingerprints-places")
    size = line.count()
    asks = line.select(F.col("key").alias("before"), F.floor(F.col("n_chars") / 2).cast("int").alias("wanted"), ((F.col("place") + 1) % max(1, size)).alias("place"))
    return asks.join(line.select("key", "place"), "place").select("key", "before", "wanted")


def edit_audit(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of an edited form, whose last half is the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions, edited_positions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), text)
    # Never null, so that no side of a join filters it and both can read one exchange.
    key = F.coalesce(F.unhex(F.md5(named.cast("binary"))), F.lit(b""))
    rows = docs.select(key.alias("key"), "doc_id", text.alias("text"))
    followers = _followers(rows.select("key", "doc_id", F.length("text").alias("n_chars")))

    # Of equal rows the first is followed by the next document, the others by their like. lag() rather than a rank, which Spark
    # would use to prune rows before the exchange: both sides below then read one exchange of the texts.
    own = rows.withColumn("opens", F.lag(F.lit(True)).over(Window.partitionBy("key").orderBy("doc_id")).isNull())
    given = own.filter("opens").join(followers, "key")
    given = given.select(F.col("before").alias("key"), F.expr("substring(text, 1, wanted)").alias("beginning"), winnow(F.col("text"))["hashes"].alias("next_hashes"))
    both = own.join(given, "key", "left").withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    beginning = F.when(F.col("opens"), F.col("beginning")).otherwise(F.substring("text", F.lit(1), half))
    edited = both.select("doc_id", "text", "n", "opens", "next_hashes", F.concat(F.substring("text", F.lit(1), F.col("n") - half), beginning).alias("edited"))
    made = edited.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "opens", "next_hashes", F.inline(F.array(F.struct(winnow(F.col("text")).alias("own"), winnow(F.col("edited")).alias("other"))))
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own.hashes")).alias("fingerprint"),
        as_text(F.col("other.hashes")).alias("edited_fingerprint"),
        likeness(F.col("own.hashes"), F.col("other.hashes")).alias("near_edited"),
        F.when(F.col("opens"), likeness(F.col("own.hashes"), F.col("next_hashes"))).otherwise(F.lit(1.0)).alias("near_next"),
        F.array_join(F.col("own.positions").cast("array<string>"), " ").alias("positions"),
        F.array_join(F.col("other.positions").cast("array<string>"), " ").alias("edited_positions"),
    )
