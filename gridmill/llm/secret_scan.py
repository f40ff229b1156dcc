"""Operator 1, secret scans, in DataFrame functions only.

Base spans come from three patterns (leftmost, non-overlapping, each kind by itself). The method adds
spans of kind ``entropy``: runs of key-like characters of at least a window's length whose Shannon
entropy, over a window sliding by one character, reaches the threshold of their character class. The
counts of the window's characters (five bits each, packed into six numbers) and the sum of
count * log2(count) are carried from step to step: a step takes one character out and one in, so the
work grows with a run's length and not with its square. A span goes from the first qualifying
window's start to the last one's end, less what base spans cover already.

Suppressed are runs on the allow-list (names and paths of words and short numbers of any length, UUIDs, runs of
digits), and windows that touch a placeholder word.

Positions: a text is split at the matches, and the gaps' and matches' lengths in code points add up. Matches are met
in blocks of BLOCK, each of which gathers its own spans, so that work grows with the number of matches and not with
its square. A span also carries how many bytes more than code points lie before it (matches themselves are ASCII):
masking cuts the text's bytes.

Defined results: a null text is empty (no spans); an empty table gives no rows; each row gets its own
result, repeated or null doc_id or not. Spans are ordered by start, then kind as in KINDS, then end.
Very long texts and keys, and texts of very many matches, are scanned whole. scan reads doc_id and text only, redact keeps all columns,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import docs_of, table

KINDS = ["assign", "access", "hex", "entropy"]
#: Fixed patterns: of an assignment the second group is the value, at least 12 characters long if the match counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
VALUE_MIN = 12
# A run that is too short has no long enough part either, so these two can ask for the length at once.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
#: Candidates of the entropy method; the window in characters.
CANDIDATE, WINDOW = "[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes, the first that fits counts, and their least entropy in bits: what 99 of 100 windows of random characters reach.
CLASSES = [("^([0-9a-f]+|[0-9A-F]+)$", 2.9), ("^[A-Z0-9=]+$", 3.3), ("^[a-z0-9]+$", 3.4), ("^[A-Za-z0-9]+$", 3.6), ("", 3.6)]
#: Words in any usual case, with up to four digits behind; a name is made of these, between single separators.
WORD, SEPARATOR = "^([A-Za-z][a-z]*([A-Z][a-z]{2,})*|[A-Z]{2,}|)[0-9]{0,4}$", "[_/=-]"
#: The same without going back, for Java: its plain groups recurse on very long words.
_WORD_AHEAD = "^(?:[A-Za-z][a-z]*+(?:[A-Z][a-z]{2,}+)*+|[A-Z]{2,}+|)[0-9]{0,4}$"
ALLOW = "^[0-9_=-]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Fixed words: windows that touch one, in either case, don't count.
PLACEHOLDERS = ["example", "placeholder", "changeme", "your", "xxxx"]
#: Every character of a candidate has a place in the counts.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,kind:int,end:int,shift:int,value:string>>"
_PLACE = "array<struct<start:int,kind:int,end:int,shift:int>>"
#: Items that are met together; what a block gives is gathered by itself.
BLOCK = 32
#: Counts in a number and bits of a count: a window's length must fit.
_PACKED, _BITS = 12, 5


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _gathered(items: Column, carry: list[str], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]], end: Callable[[Column], Column] | None = None) -> Column:
    """All that steps give for items (a column, or what _with gives), in order: step(state, item) says the next state (numbers named in carry, from 0) and an array of what is given; end(state) gives what comes last.

    Spark copies a state at each step. So one pass finds the numbers with which each block of items begins, and another gathers
    each block's results by themselves, which are laid end to end once.
    """
    plain = lambda s: F.struct(*[s[k].alias(k) for k in carry])
    zero = F.struct(*[F.lit(0).alias(k) for k in carry])
    none, no_starts = F.array().cast(kind), F.array().cast(f"array<struct<{','.join(f'{k}:int' for k in carry)}>>")
    blocks = F.sequence(F.lit(0), F.call_function("div", F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)).cast("int"))
    places = lambda k: F.filter(F.sequence(k * BLOCK, k * BLOCK + (BLOCK - 1)), lambda i: i < F.size(items))

    def moved(s: Column, k: Column) -> Column:
        keep = lambda c: F.struct(plain(c).alias("now"), F.concat(s["starts"], F.array(plain(s["now"]))).alias("starts"))
        return F.aggregate(places(k), plain(s["now"]), lambda c, i: plain(step(c, F.get(items, i))[0]), keep)

    def given(start: Column, k: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            values, more = step(s["now"], F.get(items, i))
            return F.struct(plain(values).alias("now"), F.concat(s["out"], more).alias("out"))

        return F.aggregate(places(k), F.struct(plain(start).alias("now"), none.alias("out")), one, lambda s: s["out"])

    starts = F.aggregate(blocks, F.struct(zero.alias("now"), no_starts.alias("starts")), moved, lambda s: F.concat(s["starts"], F.array(plain(s["now"]))))
    last = lambda of: F.array(end(F.element_at(of, -1))) if end else F.array().cast(f"array<{kind}>")
    return _with(starts, lambda of: F.flatten(F.concat(F.transform(blocks, lambda k: given(F.get(of, k), k)), last(of))))


def found(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans (with the matched text) of all matches; where ``least`` is given, only those whose second group has so many characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = state["at"] + F.char_length(x["gap"])
        end, shift = start + F.char_length(x["match"]), state["shift"] + F.octet_length(x["gap"]) - F.char_length(x["gap"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), shift.alias("shift"), x["match"].alias("value"))
        good = F.char_length(F.regexp_extract(x["match"], pattern, 2)) >= least if least else F.lit(True)
        return {"at": end, "shift": shift}, F.when(good, F.array(span)).otherwise(F.array().cast(_SPAN))

    # There is one gap more than there are matches: the last one is the text's rest.
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    # Most texts match nothing: they are told by one search that ends at the text's end.
    spans = _with(pairs, lambda p: _gathered(p, ["at", "shift"], _SPAN, add))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def masked(value: Column) -> Column:
    """The value with placeholder words overwritten by as many dots, which are in no key."""
    for word in PLACEHOLDERS:
        value = F.regexp_replace(value, f"(?i){word}", "." * len(word))
    return value


def entropy_spans(candidates: Column, window: int = WINDOW) -> Column:
    """Of candidate spans, the stretch covered by windows of high entropy; candidates without any are dropped."""
    # What a character that comes in as the n-th of its kind, from 0, adds to the sum of count * log2(count).
    steps = F.array(*[F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(window)])
    none = F.struct(*[F.lit(0).alias(k) for k in ("code", "word", "shift")], F.lit(0).cast("long").alias("unit"))

    def placed(x: Column) -> Column:
        """A character's place in the alphabet (from one, 0: a placeholder's dot) and in the packed counts."""

        def spread(code: Column) -> Column:
            at = F.greatest(code - 1, F.lit(0))
            shift = at % _PACKED * _BITS
            unit = F.when(code > 0, F.call_function("shiftleft", F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long"))
            return F.struct(code.alias("code"), ((at - at % _PACKED) / _PACKED).cast("int").alias("word"), shift.alias("shift"), unit.alias("unit"))

        return _with(F.instr(F.lit(ALPHABET), x), spread)

    def slide(state: Column, move: Column) -> Column:
        enter, leave = move["enter"], move["leave"]
        count = lambda c: F.call_function("shiftright", F.get(state["words"], c["word"]), c["shift"]).bitwiseAND((1 << _BITS) - 1).cast("int")

        def moved(c: Column) -> Column:
            # One in and one out: equal characters cancel.
            more = F.when(enter["code"] > 0, F.get(steps, c["n"])).otherwise(0.0)
            less = F.when(leave["code"] > 0, F.get(steps, c["m"] - 1)).otherwise(0.0)
            return F.when(enter["code"] == leave["code"], state["sum"]).otherwise(state["sum"] + more - less)

        total = _with(F.struct(count(enter).alias("n"), count(leave).alias("m")), moved)
        of = lambda c, k: F.when(c["word"] == k, c["unit"]).otherwise(F.lit(0).cast("long"))
        words = F.transform(state["words"], lambda w, k: w + of(enter, k) - of(leave, k))
        i = state["at"] + 1
        broken = F.when(enter["code"] == 0, i).otherwise(state["broken"])

        def after(t: Column) -> Column:
            high = (i - t["broken"] >= window) & (t["sum"] / window <= state["limit"] + 1e-9)
            first = F.when(high & (state["first"] == 0), i - window + 1).otherwise(state["first"])
            return F.struct(words.alias("words"), t["sum"].alias("sum"), i.alias("at"), t["broken"].alias("broken"), first.alias("first"), F.when(high, i).otherwise(state["last"]).alias("last"), state["limit"].alias("limit"))

        return _with(F.struct(total.alias("sum"), broken.alias("broken")), after)

    def stretch(c: Column) -> Column:
        value = c["value"]
        bits = F.lit(CLASSES[-1][1])
        for shape, least in reversed(CLASSES[:-1]):
            bits = F.when(value.rlike(shape), least).otherwise(bits)
        limit = F.log2(F.lit(float(window))) - bits  # entropy >= bits, as sum / window <= limit
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // _PACKED)).alias("words"), F.lit(0.0).cast("double").alias("sum"), *[F.lit(0).alias(k) for k in ("at", "broken", "first", "last")], limit.cast("double").alias("limit"))
        # One pass finds all characters; each is met with the one that leaves the window as it comes in.
        slid = lambda codes: F.aggregate(F.slice(F.arrays_zip(codes.alias("enter"), F.concat(F.array_repeat(none, window), codes).alias("leave")), F.lit(1), F.size(codes)), start, slide, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
        return F.struct(c["start"].alias("from"), c["shift"].alias("shift"), _with(F.transform(F.split(masked(value), ""), placed), slid).alias("seen"))

    allowed = lambda v: v.rlike(ALLOW) | F.forall(F.split(v, SEPARATOR), lambda word: word.rlike(_WORD_AHEAD))
    kept = F.transform(F.filter(candidates, lambda c: ~allowed(c["value"])), stretch)
    hit = F.filter(kept, lambda c: c["seen"]["last"] > 0)
    return F.transform(hit, lambda c: F.struct((c["from"] + c["seen"]["first"] - 1).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (c["from"] + c["seen"]["last"]).alias("end"), c["shift"].alias("shift")))


def uncovered(spans: Column) -> Column:
    """From base and entropy spans in order of start: the entropy spans' parts that no base span covers. One pass."""
    entropy, none = F.lit(KINDS.index("entropy")), F.array().cast(_PLACE)
    piece = lambda s, b: F.array(F.struct(s["at"].alias("start"), entropy.alias("kind"), b.alias("end"), s["shift"].alias("shift")))

    # ``at`` to ``end`` is what is left of the entropy span that came last, ``covered`` the end of base spans so far.
    def sweep(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        new = x["kind"] == entropy
        upto = F.least(state["end"], x["start"])
        covered = F.when(new, state["covered"]).otherwise(F.greatest(state["covered"], x["end"]))
        at = F.when(new, F.greatest(x["start"], state["covered"])).otherwise(F.greatest(state["at"], covered))
        then = {"at": at, "end": F.when(new, x["end"]).otherwise(state["end"]), "covered": covered, "shift": F.when(new, x["shift"]).otherwise(state["shift"])}
        return then, F.when(state["at"] < upto, piece(state, upto)).otherwise(none)

    return _gathered(spans, ["at", "end", "covered", "shift"], _PLACE, sweep, lambda s: F.when(s["at"] < s["end"], piece(s, s["end"])).otherwise(none))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, kind number, end, bytes before it less code points), in order; other columns stay."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"], s["shift"]))
    base = F.sort_array(bare(F.concat(found(t, ASSIGN, 0, VALUE_MIN), found(t, ACCESS, 1), found(t, HEX, 2))))
    out = docs.withColumn("base", base).withColumn("__more", entropy_spans(found(t, CANDIDATE, 3)))
    both = F.sort_array(F.concat("base", _with(F.sort_array(F.concat("base", "__more")), uncovered)))
    return out.withColumn("spans", F.when(F.size("__more") > 0, both).otherwise(F.col("base"))).drop("__more")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text."""
    s = with_spans(docs_of(docs))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return s.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """documents with every span of ``text`` replaced by the mask (overlapping spans by one); n_chars follows the text."""
    s = with_spans(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")))

    def rewritten(body: Column) -> Column:
        cut = lambda frm, n: F.call_function("substring", body, frm + 1, n).cast("string")

        # ``at`` is the byte up to which the text is written.
        def put(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
            start, end = x["start"] + x["shift"], x["end"] + x["shift"]
            return {"at": F.greatest(a["at"], end)}, F.when(start >= a["at"], F.array(cut(a["at"], start - a["at"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))

        return F.array_join(_gathered(F.col("spans"), ["at"], "array<string>", put, lambda a: F.array(cut(a["at"], F.octet_length(body)))), "")

    text = _with(F.col("text").cast("binary"), rewritten)
    s = s.select("row", F.when(F.size("spans") > 0, text).alias("changed"))
    new = {"text": F.col("changed"), "n_chars": F.char_length("changed")}
    of = lambda f: F.coalesce(new[f.name], F.col("row")[f.name]).cast(f.dataType) if f.name in new else F.col("row")[f.name]
    return s.select(*[of(f).alias(f.name) for f in docs.schema])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_RE_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\']?\x20*[:=]\x20*["\']?"""
_NAMED = f"regexp_matches(val, '^{WORD[1:-1]}({SEPARATOR}{WORD[1:-1]})*$')"
_BITS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(val, '{shape}') THEN {least}" for shape, least in CLASSES) + " END"
_MASKED = "val"
for _w in PLACEHOLDERS:
    _MASKED = f"regexp_replace({_MASKED}, '(?i){_w}', '{'.' * len(_w)}', 'g')"
_MATCHES = "\n  UNION ALL ".join(
    f"SELECT rid, {k} AS kind, {least} AS least, regexp_extract_all(t, $$(?s:.*?)(?:{p})$$, 0) AS parts, regexp_extract_all(t, $$(?s:.*?)({p})$$, 1) AS wholes, regexp_extract_all(t, $$(?s:.*?){q}$$, 1) AS vals FROM d"
    for k, least, p, q in (
        (0, VALUE_MIN, _RE_ASSIGN.replace("(", "(?:", 1) + "(?:[A-Za-z0-9+/_.=-]+)", _RE_ASSIGN.replace("(", "(?:", 1) + "([A-Za-z0-9+/_.=-]+)"),
        (1, 0, "AKIA[A-Z0-9]{14,}", "(AKIA[A-Z0-9]{14,})"),
        (2, 0, "[0-9a-f]{16,}", "([0-9a-f]{16,})"),
        (3, 0, "[A-Za-z0-9+/_=-]{20,}", "([A-Za-z0-9+/_=-]{20,})"),
    )
)
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  {_MATCHES}
), numbered AS (
  SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM m
), placed AS (
  SELECT rid, kind, least, list_sum(list_transform(parts[:i], lambda x: length(x)))::BIGINT AS fin, length(wholes[i]) AS n, vals[i] AS val FROM numbered
), found AS (
  SELECT rid, kind, fin - n AS start, fin, val FROM placed WHERE length(val) >= least
), base AS (
  SELECT rid, kind, start, fin FROM found WHERE kind < 3
), candidates AS (
  SELECT rid, start, {_MASKED} AS val, {_BITS_SQL} AS bits
  FROM found WHERE kind = 3 AND NOT regexp_matches(val, '{ALLOW}') AND NOT ({_NAMED})
), windows AS (
  SELECT rid, start, bits, val, unnest(range(1, length(val) - {WINDOW - 2})) AS w FROM candidates
), letters AS (
  SELECT rid, start, bits, w, unnest(string_split(substr(val, w, {WINDOW}), '')) AS c FROM windows WHERE NOT contains(substr(val, w, {WINDOW}), '.')
), counts AS (
  SELECT rid, start, bits, w, c, count(*) AS n FROM letters GROUP BY ALL
), high AS (
  SELECT rid, start, w FROM counts GROUP BY rid, start, bits, w HAVING log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} >= bits - 1e-9
), stretches AS (
  SELECT rid, start + min(w) - 1 AS start, start + max(w) + {WINDOW - 1} AS fin FROM high GROUP BY rid, high.start
), places AS (
  SELECT rid, start, unnest(range(start, fin)) AS p FROM stretches
), open_places AS (
  SELECT rid, start, p, p - row_number() OVER (PARTITION BY rid, start ORDER BY p) AS island
  FROM places WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = places.rid AND b.start <= p AND p < b.fin)
), spans AS (
  SELECT * FROM base UNION ALL
  SELECT rid, 3 AS kind, min(p) AS start, max(p) + 1 AS fin FROM open_places GROUP BY rid, start, island
), texts AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind, fin) FILTER (kind < 3) AS base,
         string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind, fin) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (rid)
"""
