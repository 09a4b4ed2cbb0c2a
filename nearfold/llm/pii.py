"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base patterns (e-mail, IP, card, phone) are always spans. Generators of high recall
propose further, overlapping candidates; boosted trees score each from its format and the
words around it; candidates over their kind's calibrated threshold are taken, best first,
if they overlap nothing taken before; runs of overlapping spans are settled one by one. Trees are trained on a small table of examples
(EXAMPLES_PER_TEMPLATE of each template) whose features the same expressions compute, and
are compiled to CASE expressions: documents meet JVM expressions only.

Offsets are code points, ends exclusive. Null and empty texts have no spans; rows are
judged by themselves, so repeated rows get equal results. Other columns are kept; output
names replace input columns.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import fresh

#: Kinds in the order in which spans that start together stand.
KINDS = ("email", "ip", "card", "phone", "iban", "id")

# The base patterns, written so that no run is scanned twice and no repetition recurses:
# a run starts where no run goes on (or where the last match ended), and repetitions are
# possessive, as nothing that follows them could match by giving back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: (generator, kind, what a text must contain, pattern)
GENERATORS = (
    ("spelled_email", "email", r"(?i)\bat\b", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])"),
    ("local_phone", "phone", r"[0-9]{2}", r"(?<![0-9+.,/-])(?:\([0-9]{2,5}\)\s?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){0,3}(?![0-9])"),
    ("joined_phone", "phone", r"[0-9]{9}", r"(?<![0-9A-Za-z+.,/-])[0-9]{9,11}(?![0-9A-Za-z])"),
    ("iban", "iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("social", "id", r"[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip_six", "ip", r":", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){2,7})(?![0-9A-Za-z:])"),
)

#: Words in front of a candidate, as patterns over its lower-cased left context.
CONTEXT = {
    "says_phone": "tel|phone|call|fax|mobile|cell|handy|dial|m.vil|appel|llam|ruf|numm?er",
    "says_mail": "mail|contact|write|reach|kontakt|correo|courriel|schreib|.crire|escrib",
    "says_id": "ssn|social|security|sozial|s.curit.|seguridad|passport|ident",
    "says_bank": "iban|account|konto|cuenta|compte|bank|transfer",
    "says_net": "ip|host|address|server|adresse|direcci",
    "says_other": "isbn|version|invoice|order|page|chapter|section|vol|price|total|date|year|score|model|part|room|ratio|time|figure|table",
}
LEFT = 28

FEATURES = (*(f"is_{g[0]}" for g in GENERATORS), "n_digits", "n_chars", "n_separators", "n_groups", "has_paren", "starts_zero", "same_separators", "checks", "bracketed", "spelled_dot", "known_end", *CONTEXT, "left_symbol", "right_symbol")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sums_before(steps: Column) -> Column:
    """Sum of the steps before each, by blocks of the square root of their number."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(a: Column, b: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / b).cast("int")), lambda j: total(F.slice(a, j * b + 1, b)))
        heads = let(sums, lambda s: F.transform(s, lambda _, j: total(F.slice(s, F.lit(1), j))))
        return let(heads, lambda h: F.transform(a, lambda _, i: F.get(h, F.floor(i / b).cast("int")) + total(F.slice(a, F.floor(i / b).cast("int") * b + 1, i % b))))

    return let(steps, lambda a: let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda b: blocks(a, b)))


SPAN = "array<struct<start:int,end:int,m:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """The leftmost matches that do not overlap, as SPAN. needs: a cheaper pattern that
    every text with a match holds."""
    none = F.array().cast(SPAN)

    def placed(s: Column) -> Column:
        steps = F.transform(s["m"], lambda x, i: F.length(F.get(s["gaps"], i)) + F.length(x))
        return let(sums_before(steps), lambda p: F.transform(s["m"], lambda x, i: F.struct((F.get(p, i) + F.length(F.get(s["gaps"], i))).cast("int").alias("start"), (F.get(p, i) + F.length(F.get(s["gaps"], i)) + F.length(x)).cast("int").alias("end"), x.alias("m"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(F.coalesce(F.rlike(text, F.lit(needs)), F.lit(False)), let(both, lambda s: F.when(F.size(s["m"]) > 0, placed(s)).otherwise(none))).otherwise(none).cast(SPAN)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) == 0) | ((F.length(x) <= 3) & (F.coalesce(F.try_to_number(F.when(F.length(x) <= 3, x), F.lit("999")), F.lit(0)) <= 255))))


def base_spans(text: Column) -> Column:
    """All base spans, array of (start, rank, kind, end) in order."""
    found = (
        ("email", matches(text, EMAIL, "@")),
        ("ip", F.filter(matches(text, IP, r"[0-9]\.[0-9]"), lambda s: valid_ip(s["m"]))),
        ("card", F.filter(matches(text, CARD, r"[0-9][\x20-]?[0-9]"), lambda s: F.call_function("luhn_check", digits(s["m"])))),
        ("phone", F.filter(matches(text, PHONE, r"\+[0-9]"), lambda s: F.length(digits(s["m"])).between(9, 15))),
    )


    def of_kind(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    return F.array_sort(F.concat(*(F.transform(x, of_kind(k)) for k, x in found)))


def iban_checks(m: Column) -> Column:
    """Remainder 1 by 97, first four characters last and letters as two digits."""
    packed = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: F.length(c) > 0), F.lit(0), lambda a, c: (a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97)
    return rest == 1


#: Code points of the pieces in which a text is cut to look around a candidate.
CELL = 1024


def around(cells: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The LEFT code points before `start` and the one at `end`, from the text's pieces of
    CELL code points, so that no look walks through the whole text."""
    empty = F.lit("")
    cell = lambda at: F.when(at >= 0, F.coalesce(F.get(cells, at), empty)).otherwise(empty)
    k = F.floor(start / CELL).cast("int")
    two, inside = F.concat(cell(k - 1), cell(k)), F.when(k > 0, start % CELL + CELL).otherwise(start)
    left = F.substring(two, F.greatest(inside - LEFT + 1, F.lit(1)), F.least(inside, F.lit(LEFT)))
    return left, F.substring(cell(F.floor(end / CELL).cast("int")), end % CELL + 1, 1)


def candidates(text: Column) -> Column:
    """All that the generators propose: start, end, rank, kind and the features."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def described(s: Column, generator: str, kind: str, cells: Column) -> Column:
        m = s["m"]
        left, right = around(cells, s["start"], s["end"])
        left = F.lower(left)
        checks = {"iban": iban_checks(m), "social": ~F.rlike(m, F.lit(r"^(?:000|666|9)|-00-|-0000$")), "ip_six": F.when(F.contains(m, F.lit("::")), F.size(F.split(m, ":")) <= 8).otherwise(F.size(F.split(m, ":")) == 8)}.get(generator, F.lit(False))
        values = [
            *(F.lit(float(g[0] == generator)) for g in GENERATORS),
            F.length(digits(m)).cast("double"),
            F.length(m).cast("double"),
            F.regexp_count(m, F.lit(r"[\x20.()/:-]")).cast("double"),
            F.regexp_count(m, F.lit("[0-9]+")).cast("double"),
            flag(F.contains(m, F.lit("("))),
            flag(F.startswith(digits(m), F.lit("0"))),
            flag(F.size(F.array_distinct(F.regexp_extract_all(m, F.lit(r"[\x20./:-]"), F.lit(0)))) <= 1),
            flag(checks),
            flag(F.rlike(m, F.lit(r"(?i)[\[({](?:at|dot)[\])}]"))),
            flag(F.rlike(m, F.lit(r"(?i)\sdot\s|\[dot\]|\(dot\)"))),
            flag(F.rlike(m, F.lit(r"(?i)(?:\.|dot\W?\s?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$"))),
            *(flag(F.rlike(left, F.lit(p))) for p in CONTEXT.values()),
            flag(F.rlike(left, F.lit(r"[#$€£%*|=<>&]\s?$"))),
            flag(F.rlike(right, F.lit(r"[#$€£%*|=<>&A-Za-z]"))),
        ]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), *(v.alias(n) for v, n in zip(values, FEATURES, strict=True)))

    def describe(generator: str, kind: str, cells: Column) -> Callable[[Column], Column]:
        return lambda s: described(s, generator, kind, cells)

    def of_text(found: Column) -> Column:
        cells = F.when(F.exists(found, lambda x: F.size(x) > 0), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0)))
        return let(cells, lambda c: F.concat(*(F.transform(F.get(found, i), describe(g, k, c)) for i, (g, k, _, _) in enumerate(GENERATORS))))

    return let(F.array(*(matches(text, pattern, needs) for _, _, needs, pattern in GENERATORS)), of_text)


# --- Training ---------------------------------------------------------------------------

#: (generator, is personal, text before, how the candidate is made): 9 is any digit, 8 any
#: digit but 0, A any capital letter, a any small letter, h any hexadecimal digit.
TEMPLATES = (
    ("spelled_email", 1, ("mail me: ", "contact ", "write to ", "E-mail: ", ""), ("aaaa.aaa (at) aaaaa.com", "aaaaa [at] aaaaaa [dot] org", "aaa99 {at} aaaa.net")),
    ("spelled_email", 1, ("mail ", "reach us: ", "Kontakt: "), ("aaaaa at aaaaaa dot com", "aaaa at aaaaaaa.org")),
    ("spelled_email", 0, ("we met ", "the price ", "", "a look ", "contact "), ("aaaa at aaaa.aaaaaa", "aaaaa at aaaaa.aaaaa", "aaaa at aaaaaa. aaa", "aaa at aaa dot aaaaaaa")),
    ("spelled_email", 0, ("we met ", "the price ", "", "a look "), ("aaaa at aaaaaa.com", "aaaa at aaaa.org")),
    ("local_phone", 1, ("call ", "Tel. ", "phone: ", "fax ", "mobile ", "Telefon: ", "appelez le "), ("(899) 899-9999", "899-899-9999", "099 8999 9999", "0999/899999", "06 99 99 99 99", "899.899.9999")),
    ("local_phone", 1, ("", "ask for Ann, ", "or "), ("(899) 899-9999", "(0999) 899999")),
    ("local_phone", 0, ("page ", "order ", "in ", "total ", "score ", "version ", "date ", ""), ("8999-8999", "89 89", "899 899", "8999-09-89", "89/89/8999", "899.89", "8 999 999", "899-99", "89.89", "899 899 899 899")),
    ("joined_phone", 1, ("call ", "Tel. ", "phone ", "mobile: "), ("8998999999", "09998999999")),
    ("joined_phone", 0, ("order ", "", "id=", "total ", "model ", "#"), ("899999999", "8999999999", "89999999999")),
    ("iban", 1, ("IBAN: ", "account ", "Konto ", ""), ("GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "ES9121000418450200051332")),
    ("iban", 0, ("part ", "", "model ", "version "), ("AA99 AAAA 9999 9999", "AA999999AAAA99", "AB12CD34EF56")),
    ("social", 1, ("SSN ", "social security no. ", "ident: "), ("899-89-8999",)),
    ("social", 0, ("part ", "ISBN ", "", "model ", "section "), ("999-99-0000", "000-89-8999", "899-89-8999", "999-00-9999")),
    ("ip_six", 1, ("host ", "IP ", "server ", ""), ("hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh", "h0:h:hhh:hhhh:hhhh:hh:h:hhhh", "he80::h", "::8", "2008::h:hh", "2008:hh8::hhhh:h")),
    ("ip_six", 0, ("time ", "at ", "ratio ", ""), ("89:99:99", "8:9:9", "hh:hh:hh:hh:hh:hh")),
)
EXAMPLES_PER_TEMPLATE = 4
AFTER = (" today.", ", please", ".", " and more", "")


def examples(seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, generator, is personal) by rule from TEMPLATES."""
    rng = random.Random(seed)
    kinds = {"9": "0123456789", "8": "23456789", "A": "BCDGHKMNPRSTVWXZ", "a": "abcdefghilmnoprstuv", "h": "0123456789abcdef"}
    out = []
    for generator, label, befores, forms in TEMPLATES:
        for before in befores:
            for form in forms:
                for _ in range(EXAMPLES_PER_TEMPLATE):
                    literal = generator == "iban" and label
                    words = ("com", "org", "net", " at ", "(at)", "[at]", "{at}", "dot")
                    made, i = "", 0
                    while i < len(form):
                        word = next((w for w in words if generator == "spelled_email" and form.startswith(w, i)), None)
                        made += word or (form[i] if literal else rng.choice(kinds.get(form[i], form[i])))
                        i += len(word) if word else 1
                    start = rng.choice(("", "Then he said: ", "In the end, "))
                    text = start + before + made + rng.choice(AFTER)
                    out.append((text, len(start + before), len(start + before + made), generator, label))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 4, ridge: float = 1.0):
    """Trees on the logistic loss: a leaf is a float, a node (feature, cut, below, above)."""
    f, trees = np.zeros(len(y)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = float(rate * g[rows].sum() / (h[rows].sum() + ridge))
        best, gain = None, 1e-6
        if left and len(rows) >= 2 * least:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
            for j in range(x.shape[1]):
                order = rows[np.argsort(x[rows, j], kind="stable")]
                v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
                for i in np.flatnonzero(np.diff(v)):
                    if i + 1 < least or len(rows) - i - 1 < least:
                        continue
                    new = gs[i] ** 2 / (hs[i] + ridge) + (gs[-1] - gs[i]) ** 2 / (hs[-1] - hs[i] + ridge) - whole
                    if new > gain:
                        best, gain = (j, float((v[i] + v[i + 1]) / 2)), new
        if best is None:
            return value
        j, cut = best
        return (j, cut, grow(rows[x[rows, j] < cut], g, h, left - 1), grow(rows[x[rows, j] >= cut], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        trees.append(tree)
        f += np.array([walk(tree, r) for r in x])
    return trees


def walk(tree, row) -> float:
    while not isinstance(tree, float):
        j, cut, below, above = tree
        tree = below if row[j] < cut else above
    return tree


def calibrate(f: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Platt's a and b of 1 / (1 + exp(-(a f + b))), by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * f + b)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - goal) * f).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        hess = np.array([[(w * f * f).sum() + 1e-3, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def thresholds(p: np.ndarray, y: np.ndarray, kinds: Sequence[str], precision: float = 0.98, least: float = 0.7) -> dict[str, float]:
    """For each kind the lowest probability from which on so many are personal."""
    out = {}
    for kind in KINDS:
        mine = np.array([k == kind for k in kinds])
        out[kind] = 2.0  # nothing is taken of a kind without examples
        for t in sorted(set(p[mine]), reverse=True):
            if t < least or y[mine & (p >= t)].mean() < precision:
                break
            out[kind] = float(t)
        if out[kind] < 2:  # half way to the next lower one, so that equals are taken in
            lower = [v for v in p[mine] if v < out[kind]]
            out[kind] = max(least, (out[kind] + max(lower, default=least)) / 2)
    return out


@lru_cache(maxsize=4)
def model(spark: SparkSession, seed: int = 11):
    """Trees, (a, b), thresholds by kind; trained on the driver from the example table."""
    rows = examples(seed)
    table = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i long, text string")
    found = table.select("i", F.explode(candidates(F.col("text"))).alias("c")).select("i", "c.*").collect()
    x, y, kinds, part = [], [], [], []
    for c in sorted(found, key=lambda r: (r["i"], r["rank"], r["start"], [r[f] for f in FEATURES])):
        _, start, end, generator, label = rows[c["i"]]
        if not c[f"is_{generator}"]:
            continue  # another generator's proposal has no label here
        if (label and (c["start"], c["end"]) != (start, end)) or c["end"] <= start or c["start"] >= end:
            continue
        x.append([c[f] for f in FEATURES])
        y.append(label)
        kinds.append(c["kind"])
        part.append(c["i"] % EXAMPLES_PER_TEMPLATE == 0)  # a quarter calibrates
    x, y, part = np.array(x, float), np.array(y, float), np.array(part)
    trees = boost(x[~part], y[~part])
    f = np.array([sum(walk(t, r) for t in trees) for r in x])
    a, b = calibrate(f[part], y[part])
    p = 1 / (1 + np.exp(-(a * f + b)))
    return trees, (a, b), thresholds(p[part], y[part], [k for k, u in zip(kinds, part, strict=True) if u])


def tree_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    j, cut, below, above = tree
    return f"CASE WHEN c.{FEATURES[j]} < {cut!r}D THEN {tree_sql(below)} ELSE {tree_sql(above)} END"


def find_pii(docs: DataFrame, text_col: str = "text", base_col: str = "base", spans_col: str = "spans", keep: Sequence[str] | None = None) -> DataFrame:
    """docs (or the columns `keep` of it) with base and spans, arrays of
    (start, rank, kind, end) in order of start, then kind."""
    trees, (a, b), limit = model(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (base_col.lower(), spans_col.lower())]
    proposed = fresh("proposed", [*keep, base_col, spans_col])
    text = docs[text_col].cast("string")
    frame = docs.select(*[docs[c] for c in keep], base_spans(text).alias(base_col), candidates(text).alias(proposed))
    score = " + ".join(f"({tree_sql(t)})" for t in trees)
    least = " ".join(f"WHEN '{k}' THEN {math.log(t / (1 - t)) if t < 1 else 1e9!r}D" for k, t in limit.items())
    taken = F.expr(f"array_sort(filter(transform(`{proposed}`, c -> struct(-({a!r}D * ({score}) + {b!r}D) AS worse, c.start AS start, c.rank AS rank, c.kind AS kind, c.end AS end)), s -> -s.worse >= CASE s.kind {least} END))")
    taken = F.when(F.size(proposed) > 0, taken)
    frame = frame.select(*keep, base_col, taken.alias(proposed))
    return frame.select(*keep, base_col, F.when(F.size(proposed) > 0, settled(F.col(base_col), F.col(proposed))).otherwise(F.col(base_col)).alias(spans_col))


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def clusters(spans: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(first, size) for each run of overlapping spans, places in `spans`, which are
    ordered by start. A run begins where as many spans have ended as began before."""

    def runs(ends: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(spans) - 1)
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1)))
        return let(firsts, lambda f: F.transform(f, lambda at, j: body(at, F.coalesce(F.get(f, j + 1), F.size(spans)) - at)))

    return let(F.array_sort(F.transform(spans, lambda s: s["end"])), runs)


def settled(base: Column, proposed: Column) -> Column:
    """The base spans and, best first, the proposed ones (worse, start, rank, kind, end)
    that overlap nothing taken before, in order. Every run of overlapping spans is settled
    by itself, so the work follows the spans and not their square."""
    every = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(None).cast("double").alias("worse"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))), F.transform(proposed, lambda s: F.struct(s["start"].alias("start"), s["worse"].alias("worse"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))))
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))

    def one_run(spans: Column) -> Callable[[Column, Column], Column]:
        def run(first: Column, size: Column) -> Column:
            return F.when(size == 1, F.transform(F.slice(spans, first + 1, size), plain)).otherwise(let(F.slice(spans, first + 1, size), best_first))

        return run

    def best_first(run: Column) -> Column:
        fixed = F.transform(F.filter(run, lambda s: s["worse"].isNull()), plain).cast(SPANS)
        order = F.array_sort(F.transform(F.filter(run, lambda s: s["worse"].isNotNull()), lambda s: F.struct(s["worse"], s["start"], s["rank"], s["kind"], s["end"])))
        free = lambda acc, c: ~F.exists(acc, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return F.aggregate(order, fixed, lambda acc, c: F.when(free(acc, c), F.concat(acc, F.array(plain(c)).cast(SPANS))).otherwise(acc))

    return let(every, lambda spans: F.array_sort(F.flatten(clusters(spans, one_run(spans)))))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first one's kind. What
    lies between is put together from pieces of the text, so no look walks through all of it."""

    def runs(ordered: Column) -> Column:
        def run(first: Column, size: Column) -> Column:
            return F.struct(F.get(ordered, first)["start"].alias("start"), F.get(ordered, first)["kind"].alias("kind"), F.array_max(F.transform(F.slice(ordered, first + 1, size), lambda s: s["end"])).alias("end"))

        return clusters(ordered, run)

    def written(r: Column) -> Column:
        cells = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))
        begins = F.transform(r, lambda s, i: F.when(i == 0, 0).otherwise(F.get(r, i - 1)["end"]))
        last = F.element_at(r, -1)["end"]

        def parts(c: Column, at: Column) -> Column:
            kinds = F.transform(r, lambda s, i: F.concat(between(c, F.get(at, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.concat(F.array_join(kinds, ""), between(c, last, F.lit(None).cast("int")))

        return let(cells, lambda c: let(begins, lambda at: parts(c, at)))

    return F.when(F.size(spans) > 0, let(let(F.array_sort(spans), runs), written)).otherwise(text)


def between(cells: Column, start: Column, end: Column) -> Column:
    """The text from start to end (to its end, if null), given in pieces of CELL code points."""
    k = F.floor(start / CELL).cast("int")
    upto = F.coalesce(end, F.size(cells) * CELL)
    some = F.slice(cells, k + 1, F.floor((upto - 1) / CELL).cast("int") - k + 1)
    return F.when(upto > start, F.substring(F.array_join(some, ""), start - k * CELL + 1, upto - start)).otherwise(F.lit(""))


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    found = find_pii(docs, keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
