"""Personal data: base patterns, and gradient-boosted candidates.

High-recall generators propose spans, which may overlap: loose phone numbers, national ids, account numbers and
spelled-out mail addresses. Each gets format features (digits, separators, groups, letters) and context features (a
telling word just before it). A small gradient-boosted tree model scores it; a threshold for each kind, calibrated on
held-out candidates for a wanted precision, selects what joins the base spans. Base spans always stay; a candidate that
overlaps one is dropped, and of overlapping candidates those of the highest scores are kept, the first of equal ones.

The model is trained here, on the driver, from labelled candidates that ``training_rows`` writes from seeded formats
(bounded: TRAIN_ROWS, of which a quarter trains and the rest calibrates), so its precision and recall are those on such
formats. The trees become CASE expressions, so scoring runs inside Spark's own functions.

Nulls: a null text counts as empty. Empty texts have no spans. Very long texts are scanned whole, with possessive
patterns that need linear time. Ties: spans are sorted by start, then kind as listed. Repeated rows are scanned one by
one. Empty tables give no rows. Extra columns stay, whatever their names; columns named like a result are replaced.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm._native import found, let, listed, masked, prefix, tagged, whole

#: Base patterns; fixed values. \G lets a match begin where the last one ended, inside a run of its first characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidate generators: kind, pattern.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z.+-])(?:0[0-9](?:[\x20./-][0-9]{2}){4}|\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}(?:[\x20./-][0-9]{2,5}){1,2})(?![0-9A-Za-z])"),
    ("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]{1,63})+"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?:\x20dot\x20[a-z0-9_-]{1,63}){0,3}\x20at\x20[a-z0-9-]{1,63}(?:\x20dot\x20[a-z0-9-]{1,63}){1,3}(?![a-z0-9])"),
)
KINDS = ("email", "ip", "card", "phone", "national_id", "account")
CONTEXT = 28
TELLING = r"(?i)\b(?:tel|phone|call|mobile|cell|fax|ssn|social|security|iban|account|konto|compte|cuenta|mail|email|contact|id|nr|no)\b\W{0,3}(?:\w+\W{1,3}){0,1}$"

#: How a spelled-out address ends.
DOMAIN = r"(?i)[^a-z](?:com|org|net|edu|gov|info|de|fr|es|uk|io|eu)$"

TRAIN_ROWS = 4000
ROUNDS = 24
RATE = 0.4
PRECISION = 0.98
#: Feature, expression over m (the candidate) and before (what stands before it); the same text is compiled for Spark and for training.
FEATURES = ("digits", "letters", "marks", "groups", "equal_groups", "telling", "is_date", "at_words", "leading_zero", "domain")


def features_of(m: str, before: str) -> list[float]:
    """The features of one candidate, for training; ``features`` is the same as Spark columns."""
    groups = [g for g in re.split(r"[^0-9]+", m) if g]
    return [
        float(len(re.sub(r"[^0-9]", "", m))), float(len(re.sub(r"[^A-Za-z]", "", m))), float(len(re.sub(r"[A-Za-z0-9]", "", m))), float(len(groups)),
        float(len({len(g) for g in groups}) == 1), float(bool(re.search(TELLING, before))), float(bool(re.search(r"^(?:19|20)[0-9]{2}[./-]|[./-](?:19|20)[0-9]{2}$", m))),
        float(bool(re.search(r"(?i)[\[(]\x20?at\x20?[\])]", m))), float(m[:1] == "0" or m[:2] == "(0"), float(bool(re.search(DOMAIN, m))),
    ]


def features(m: Column, before: Column) -> dict[str, Column]:
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    flag = lambda c: c.cast("double")
    return {
        "digits": F.length(F.regexp_replace(m, "[^0-9]", "")).cast("double"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        "marks": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        "groups": F.size(groups).cast("double"),
        "equal_groups": flag(F.size(F.array_distinct(F.transform(groups, lambda g: F.length(g)))) == 1),
        "telling": flag(before.rlike(TELLING)),
        "is_date": flag(m.rlike(r"^(?:19|20)[0-9]{2}[./-]|[./-](?:19|20)[0-9]{2}$")),
        "at_words": flag(m.rlike(r"(?i)[\[(]\x20?at\x20?[\])]")),
        "leading_zero": flag(m.rlike(r"^\(?0")),
        "domain": flag(m.rlike(DOMAIN)),
    }


def training_rows(n: int = TRAIN_ROWS, seed: int = 7) -> list[tuple[str, list[float], int]]:
    """(kind, features, label) of candidates from formats: personal numbers and addresses against dates, sizes, versions, part numbers and sums."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    up = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    end = lambda: rng.choice(("com", "org", "net", "de", "fr"))
    good = [
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}", "tel: "), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}", "call "), ("phone", lambda: f"0{d(2)} {d(4)} {d(4)}", "phone "), ("phone", lambda: f"0{d(3)}/{d(3)} {d(4)}", "mobile: "),
        ("phone", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", "tel "), ("phone", lambda: f"0{d(4)} {d(3)} {d(3)}", "Fax: "),
        ("national_id", lambda: f"{d(3)}-{d(2)}-{d(4)}", "SSN "), ("account", lambda: f"{up(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", "IBAN "),
        ("email", lambda: f"{word()} [at] {word()} [dot] {end()}", "mail "), ("email", lambda: f"{word()}(at){word()}.{end()}", "contact "), ("email", lambda: f"{word()} dot {word()} at {word()} dot {end()}", "mail "),
    ]
    bad = [
        ("phone", lambda: f"{rng.randint(1, 28):02d}-{rng.randint(1, 12):03d}-20{d(2)}", "on "), ("phone", lambda: f"20{d(2)}-{d(3)}-{d(2)}", "released "), ("phone", lambda: f"20{d(2)}-{d(3)}-{d(4)}", "invoice "), ("phone", lambda: f"{d(3)} {d(3)} {d(3)}", "total of "), ("phone", lambda: f"{d(2)}.{d(3)}.{d(3)}", "costs "),
        ("account", lambda: f"{up(2)}{d(2)}{up(4)}{up(4)}{up(4)}", "part "), ("national_id", lambda: f"{d(3)}-{d(2)}-{d(4)}", "item "), ("phone", lambda: f"{d(4)} {d(4)} {d(4)}", "serial "), ("phone", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", "count "),
        ("email", lambda: f"{word()} at {word()} dot {word()}", "look "), ("email", lambda: f"{word()} (at) {word()}.{word()}", "meet "),
    ]
    out = []
    for i in range(n):
        label = i % 2
        kind, make, lead = rng.choice(good if label else bad)
        bare = rng.random() < (0.15 if label else 0.9)
        before = f"{word()} {word()} " if bare else f"{word()} {lead}"
        out.append((kind, features_of(make(), before), label))
    return out


def _leaf(rows, grads, hess) -> float:
    return sum(grads[i] for i in rows) / (sum(hess[i] for i in rows) + 1.0)


def _split(xs, rows, grads, hess):
    """The best (feature, cut) of rows by gain, over a grid of cuts."""
    best = (1e-9, None)
    whole_g, whole_h = sum(grads[i] for i in rows), sum(hess[i] for i in rows)
    for f in range(len(FEATURES)):
        for cut in sorted({xs[i][f] for i in rows})[:-1]:
            left = [i for i in rows if xs[i][f] <= cut]
            g, h = sum(grads[i] for i in left), sum(hess[i] for i in left)
            gain = g * g / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g * whole_g / (whole_h + 1)
            if gain > best[0]:
                best = (gain, (f, cut))
    return best[1]


def _tree(xs, rows, grads, hess, depth):
    cut = _split(xs, rows, grads, hess) if depth else None
    if cut is None:
        return _leaf(rows, grads, hess)
    f, at = cut
    return f, at, _tree(xs, [i for i in rows if xs[i][f] <= at], grads, hess, depth - 1), _tree(xs, [i for i in rows if xs[i][f] > at], grads, hess, depth - 1)


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=1)
def model() -> tuple[list, dict[str, float]]:
    """Trees of depth two by Newton boosting on a quarter of the rows; for each kind the least score that keeps PRECISION on the others of its rows."""
    rows = training_rows()
    train, held = rows[: len(rows) // 4], rows[len(rows) // 4 :]
    xs, ys = [x for _, x, _ in train], [y for *_, y in train]
    scores, trees = [0.0] * len(xs), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = _tree(xs, range(len(xs)), [y - q for y, q in zip(ys, p)], [q * (1 - q) for q in p], 2)
        trees.append(tree)
        scores = [s + RATE * _value(tree, x) for s, x in zip(scores, xs)]
    thresholds = {}
    for kind in dict.fromkeys(k for k, *_ in rows):
        judged = sorted(((score_of(trees, x), y) for k, x, y in held if k == kind), reverse=True)
        threshold, hits = math.inf, 0
        for n, (s, y) in enumerate(judged, 1):
            hits += y
            if hits >= PRECISION * n and (n == len(judged) or judged[n][0] < s):  # equal scores pass together
                threshold = s
        thresholds[kind] = threshold - 1e-9
    return trees, thresholds


def score_of(trees: list, x: list[float]) -> float:
    return sum(RATE * _value(t, x) for t in trees)


def _case(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(x[FEATURES[f]] <= cut, _case(low, x)).otherwise(_case(high, x))


def score(m: Column, before: Column) -> Column:
    trees, _ = model()
    x = F.struct(*[c.alias(n) for n, c in features(m, before).items()])
    return let(x, lambda v: sum((F.lit(RATE) * _case(t, v) for t in trees), F.lit(0.0)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(
            F.reverse(F.filter(F.split(digits, ""), lambda x: x != "")),
            lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(let(x.cast("int") * 2, lambda y: F.when(y > 9, y - 9).otherwise(y))),
        ),
        F.lit(0), lambda a, b: a + b,
    )
    return total % 10 == 0


def _card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (F.length(digits).between(14, 19)) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _ip(m: Column) -> Column:
    parts = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(999) <= 255))


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans and spans: arrays of (s, o, e, k, m) sorted by start, then kind."""
    made = ["base_spans", "spans"]
    kept, p = [F.col(f"`{c}`") for c in df.columns if c not in made], prefix(df)
    t = whole(F.col(text))
    _, thresholds = model()
    out = df.select(
        *kept,
        found(t, EMAIL).alias(f"{p}email"),
        F.filter(found(t, IP), lambda x: _ip(x["m"])).alias(f"{p}ip"),
        F.filter(found(t, CARD), lambda x: _card(x["m"])).alias(f"{p}card"),
        F.filter(found(t, PHONE), lambda x: _phone(x["m"])).alias(f"{p}phone"),
        *[found(t, pattern).alias(f"{p}g{i}") for i, (_, pattern) in enumerate(GENERATORS)],
    )
    base = [tagged(F.col(f"{p}{k}"), k, i) for i, k in enumerate(KINDS[:4])]
    proposed = [tagged(F.col(f"{p}g{i}"), k, KINDS.index(k)) for i, (k, _) in enumerate(GENERATORS)]
    out = out.select(*kept, F.array_sort(F.concat(*base)).alias("base_spans"), F.array_sort(F.concat(*proposed)).alias(f"{p}all"))
    b = F.col("base_spans")

    def scored(x: Column) -> Column:
        start = F.greatest(x["s"] - CONTEXT, F.lit(0))
        return F.struct((-score(x["m"], F.substring(t, start + 1, x["s"] - start))).alias("minus"), *[x[f].alias(f) for f in ("s", "o", "e", "k", "m")])

    least = F.create_map(*[c for k, v in thresholds.items() for c in (F.lit(k), F.lit(float(v)))])
    free = F.filter(f"{p}all", lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    good = F.array_sort(F.filter(F.transform(free, scored), lambda x: -x["minus"] >= least[x["k"]]))
    none = F.array().cast("array<struct<s:int,o:int,e:int,k:string,m:string>>")

    def taken(so_far: Column, x: Column) -> Column:
        span = F.struct(*[x[f].alias(f) for f in ("s", "o", "e", "k", "m")])
        return F.when(F.exists(so_far, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), so_far).otherwise(F.concat(so_far, F.array(span)))

    more = F.when(F.size(f"{p}all") > 0, F.aggregate(good, none, taken))
    return out.select(*kept, "base_spans", F.array_sort(F.concat(b, F.coalesce(more, F.slice(b, 1, 0)))).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with each span replaced by <KIND>; a null text stays null."""
    hit = scan(df, text)
    changed = F.when(F.size("spans") > 0, masked(whole(F.col(text)), F.col("spans"))).otherwise(F.col(text))
    return hit.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def digest(spans: Column) -> Column:
    return F.sha2(listed(spans), 256)
