"""PII by candidate gradient boosting: generators propose spans, boosted trees score them, thresholds select."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskwright.llm.common import id_and_text, public_id, written

#: Kinds in the order of their spans: the four with fixed rules, then those that only the method finds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "birth", "secret")
#: Fixed rules. A match starts at the end of the last or where its run begins; elsewhere in a run it could only fail
#: the same way, so long runs take linear time. Groups are possessive where what follows them cannot match inside.
_RUN = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
RULES = {
    "email": (_RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+"))),
}
#: Generators: what may be personal data in forms that the rules leave out. Several kinds share a generator.
GENERATORS = {
    "written_email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+)++", lambda t: t.rlike(r"\(at\)|\[at\]|\{at\}| at ") & t.rlike(r" dot |\(dot\)|\[dot\]|\{dot\}| at [A-Za-z0-9-]+\.[A-Za-z0-9]")),
    "number": (r"(?:\G|(?<![0-9]))\(?[0-9]{3}\)?[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{3,4}(?![0-9])", lambda t: t.rlike(r"[0-9]{3}")),
    "abroad": (r"(?<![0-9A-Za-z.])00[1-9][0-9]{0,2}[\x20./-]?\(?[0-9]{1,5}\)?(?:[\x20./-]?[0-9]{2,5}){1,4}(?![0-9])", lambda t: F.contains(t, F.lit("00"))),
    "ipv6": (r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,5}|(?:[0-9A-Fa-f]{1,4}::)(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])", lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:")),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
    "date": (r"(?<![0-9./-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9])", lambda t: t.rlike(r"(?:19|20)[0-9]{2}")),
    "secret": (r"(?:token|secret|password|passwd|pwd|api[_-]?key|TOKEN|SECRET|PASSWORD|API[_-]?KEY)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9/+_.-]{8,}|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[po]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z-]{20,})", lambda t: t.rlike(r"[:=]|AKIA|gh[po]_|sk-")),
}
KIND_OF = {"written_email": ("email",), "number": ("phone", "ssn"), "abroad": ("phone",), "ipv6": ("ip",), "account": ("iban",), "date": ("birth",), "secret": ("secret",)}
#: Bounds of the fit: invented candidates for each generator's kind, and texts whose surroundings they are put in.
PER_KIND, CARRIERS, CARRIER_CHARS = 600, 256, 60
#: Boosting. LEAST_PRECISION is what a threshold must reach on the half that the trees have not seen.
ROUNDS, RATE, LEAST_PRECISION, SEED = 24, 0.4, 0.97, 11


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return n.between(14, 19) & F.coalesce(F.call_function("luhn_check", F.when(n <= 19, _digits(m))), F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


_PIECE = "array<struct<kind:string,pos:int,gap:int,size:int,match:string,before:string,head:string>>"


def _pieces(kind: str, pattern: str) -> Column:
    """For each match, and for the text after the last, the gap before it."""

    def piece(x, i):
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("pos"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["m"]).alias("size"),
            x["m"].alias("match"),
            F.right(x["gap"], F.lit(24)).alias("before"),
            F.left(x["gap"], F.lit(24)).alias("head"),
        )

    return F.transform(F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.col(kind).alias("m")), piece).cast(_PIECE)


def matches(base: DataFrame, patterns: dict) -> DataFrame:
    """(id, kind, start, end, match, before, after) of each pattern's leftmost non-overlapping matches, in code points.

    before, after: up to 24 code points around the match, as far as the matches next to it. Positions are running sums
    over a document's matches, which meet in one task as one text does; texts are not shuffled.
    """
    found = []
    for kind, (pattern, likely) in patterns.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found.append(F.when(likely(F.col("text")), hits).otherwise(F.array().cast("array<string>")).alias(kind))
    held = base.select("id", "text", *found).filter(" or ".join(f"size({k}) > 0" for k in patterns))
    each = F.flatten(F.array(*[F.when(F.size(k) > 0, _pieces(k, p)).otherwise(F.array().cast(_PIECE)) for k, (p, _) in patterns.items()]))
    rows = held.select("id", F.explode(each).alias("x")).select("id", "x.*")
    order = W.partitionBy("id", "kind").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)).withColumn("after", F.lead("head").over(order))
    return placed.filter("match is not null").select("id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "match", "before", F.coalesce("after", F.lit("")).alias("after"))


def _check97(m: Column) -> Column:
    """The ISO 7064 MOD 97-10 remainder of an account number, whose first four signs count last."""
    plain = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda t, c: F.when(c == "", t).otherwise((t * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


#: Features of a candidate, from its format and its context; all are numbers.
def features(m: Column, before: Column, after: Column) -> dict[str, Column]:
    near = F.lower(before)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    count = lambda p: F.length(F.regexp_replace(m, p, "")).cast("double")
    return {
        "length": F.length(m).cast("double"),
        "digits": count("[^0-9]"),
        "letters": count("[^A-Za-z]"),
        "blanks": count("[^ ]"),
        "dots": count("[^.]"),
        "hyphens": count("[^-]"),
        "colons": count("[^:]"),
        "groups": F.size(F.split(m, r"[ ./:()-]+")).cast("double"),
        "first_group": F.length(F.regexp_extract(m, "^[(]?([0-9]*)", 1)).cast("double"),
        "last_group": F.length(F.regexp_extract(m, "([0-9]*)$", 1)).cast("double"),
        "first_number": F.coalesce(F.left(_digits(m), F.lit(3)).try_cast("double"), F.lit(0.0)),
        "bracketed": flag(m.rlike(r"^\([0-9]{3}\)")),
        "check": flag((F.length(_digits(m)) > 8) & m.rlike("^[A-Z]{2}[0-9]") & (_check97(F.when(m.rlike("^[A-Z]{2}[0-9]"), m)) == 1)),
        "double_colon": flag(F.contains(m, F.lit("::"))),
        "marked_at": flag(m.rlike(r"[(\[{]at[)\]}]")),
        "marked_dot": flag(m.rlike(r"[(\[{]dot[)\]}]| dot ")),
        "domain": flag(m.rlike(r"(?i)(?:com|org|net|edu|gov|io|info|co|uk|de|fr|es|example)$")),
        "mixed": flag(m.rlike(r"(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])[^ :=]{12,}$")),
        "quoted": flag(m.rlike("[\"']")),
        "phone_word": flag(near.rlike(r"(?:phone|tel|call|mobile|cell|fax|dial|text|contact|ruf|appel)[a-z]*[.:]? *(?:is|at|me|us|on|no\.?|number)?:? *$")),
        "ssn_word": flag(near.rlike(r"(?:ssn|social security|soc\. sec|security number|s\.s\.n)[a-z .:#]*$")),
        "birth_word": flag(near.rlike(r"(?:born|birth|dob|geboren|geburt|naissance|nacid|nacimiento)[a-z]*[ .:,]*(?:on|am|le|el|date|day)?:? *$")),
        "account_word": flag(near.rlike(r"(?:iban|account|konto|compte|cuenta|transfer)[a-z]*[ .:#]*(?:no\.?|number|to)?:? *$")),
        "mail_word": flag(near.rlike(r"(?:mail|contact|write|reach|address)[a-z]*(?: (?:me|us|is|to|at))?:? *$")),
        "address_word": flag(near.rlike(r"(?:ip|host|server|address|from|ping|client)[a-z]*[ :=]*$")),
        "other_word": flag(near.rlike(r"(?:version|order|invoice|item|part|model|id|ref|no|page|chapter|isbn|sku|build|v|serial|time|updated|published)[.:# ]*$|[$#€£]$")),
        "joined": flag(before.rlike(r"[A-Za-z0-9+_./$#-]$") | after.rlike(r"^[A-Za-z0-9_/-]|^\.[0-9]")),
    }


def labelled_sample(carriers: list[str], n: int = PER_KIND, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(kind, match, before, after, label): invented candidates of each generator and kind, personal or not.

    What is personal is chosen first, then written in one of several forms; the same forms are given to numbers of other
    use, mostly with other words before them. Around them stand pieces of the carriers, real texts of the table.
    """
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda a=3, b=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    pick = rng.choice
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def around(lead: str) -> tuple[str, str]:
        text = pick(carriers)
        at = rng.randint(0, len(text))
        left, right = text[:at], text[at:]
        left = left if not left or left[-1].isspace() else left + " "
        return (left + lead)[-24:], (pick(["", " ", ".", ", ", "\n", ")"]) + right)[:24] if rng.random() < 0.7 else " " + right[:23]

    def account() -> str:
        body = num(pick([14, 16, 18]))
        country = pick(["DE", "FR", "ES", "GB", "NL"])
        own = f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"
        whole = country + own + body
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.6 else whole

    def date() -> str:
        d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1930, 2024)
        return pick([f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}", f"{y}-{m:02d}-{d:02d}", f"{d:02d}-{m:02d}-{y}"])

    def us(sep: str) -> str:
        return f"{pick('23456789')}{num(2)}{sep}{pick('23456789')}{num(2)}{sep}{num(4)}"

    def one(kind: str, yes: bool) -> tuple[str, str]:
        """The match and the words before it."""
        other = pick(["order ", "part no. ", "invoice ", "ref ", "serial ", "version ", "item ", "", "id "])
        if kind == "phone":
            if yes:
                m = pick([us("-"), us("."), us(" "), f"({pick('23456789')}{num(2)}) {num(3)}-{num(4)}"])
                return m, pick(["call ", "Phone: ", "tel. ", "mobile ", "contact us at ", "", "", ""])
            m = pick([num(9), num(10), f"{num(3)}.{num(3)}.{num(3)}", f"{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(3)}", num(8), us("-"), us("."), f"{num(3)}-{num(2)}-{num(4)}"])
            return (m, pick(["", "SSN ", "social security number "])) if m.count("-") == 2 and len(m) == 11 else (m, pick(["order ", "part no. ", "invoice ", "ref ", "serial ", "#", "x/", hexes(5), f"{num(4)} "]))
        if kind == "abroad":
            m = f"00{pick(['49', '33', '34', '44', '1'])}{pick([' ', '-', '/', ' ('])}{num(rng.randint(2, 4))}"
            m = (m + ")" if "(" in m else m) + pick([" ", "-", ""]) + num(rng.randint(5, 7))
            return (m, pick(["call ", "Tel: ", "phone ", "", "fax "])) if yes else (pick([m, "00" + num(8), "00" + num(9)]), pick(["order ", "part no. ", "serial ", "item ", "ref "]))
        if kind == "ssn":
            m = f"{rng.choice([rng.randint(1, 665), rng.randint(667, 899)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
            if yes:
                return (m, pick(["", "", "SSN ", "ssn: ", "social security number "])) if rng.random() < 0.85 else (m.replace("-", " "), pick(["SSN ", "social security number "]))
            m = pick([f"9{num(2)}-{num(2)}-{num(4)}", m, f"{num(3)} {num(2)} {num(4)}", num(9), num(8), num(10), us("-"), us("-"), f"{num(3)}.{num(2)}.{num(4)}"])
            return m, pick(["call ", "Phone: ", "", ""]) if len(m) == 12 else pick(["order ", "part no. ", "serial ", "item ", "#", hexes(5), f"{num(4)} "])
        if kind == "email":
            if not yes:
                return (f"{word()} at {word()}.{word(1, 3).capitalize()}" if rng.random() < 0.8 else f"{word()} at {word()}.{num(2)}"), ""
            at, dot = pick([("(at)", "(dot)"), ("[at]", "[dot]"), ("[at]", "."), (" at ", " dot "), ("(at)", "."), ("{at}", "{dot}")])
            gap = pick(["", " "]) if at != " at " else ""
            inner = gap if dot not in (".", " dot ") else ""
            return f"{word()}{gap}{at}{gap}{word()}{inner}{dot}{inner}{pick(['com', 'org', 'net', 'de', 'io'])}", pick(["", "mail me: ", "contact "])
        if kind == "ip":
            full = ":".join(hexes(rng.randint(1, 4)) for _ in range(8))
            short = f"{hexes(4)}:{hexes(4)}::{hexes(rng.randint(1, 4))}"
            return (pick([full, short, f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}"]), pick(["", "host ", "address "])) if yes else (f"{num(2)}:{num(2)}:{num(2)}" + pick(["", f":{num(2)}"]), pick(["", "time ", "at "]))
        if kind == "iban":
            return (account(), pick(["", "IBAN ", "account: ", "transfer to "])) if yes else (f"{pick('ABCDEFG')}{pick('KLMNOP')}{num(2)} {num(4)} {num(4)}" + pick(["", " " + num(4)]), other)
        if kind == "birth":
            return date(), pick(["born ", "born on ", "date of birth: ", "DOB ", "geboren am ", "birthday "]) if yes else pick(["", "updated ", "on ", "published ", "from ", ""])
        name = pick(["token", "secret", "password", "api_key", "pwd"])
        if not yes:
            return f"{name}{pick([': ', '=', ' = '])}{word(8, 12)}", ""
        made = pick([hexes(pick([16, 18, 32, 40])), word(4, 8) + num(3) + word(2, 5), "AKIA" + num(8) + "ABCDEFGH", "ghp_" + hexes(36)])
        return (made if made[:4] in ("AKIA", "ghp_") and rng.random() < 0.5 else f'{name}{pick([" = ", "=", ": "])}{pick(["", chr(34)])}{made}'), ""

    out = []
    for kind in ("email", "phone", "abroad", "ssn", "ip", "iban", "birth", "secret"):
        for _ in range(n):
            yes = rng.random() < 0.5
            m, lead = one(kind, yes)
            out.append((kind, m, *around(lead), int(yes)))
    return out


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, float] | None:
    best = None
    total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        cut = np.flatnonzero(x[order[1:], f] > x[order[:-1], f])
        if not len(cut):
            continue
        gl, hl = np.cumsum(g[order])[cut], np.cumsum(h[order])[cut]
        gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - total
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), f, float(x[order[cut[k]], f]))
    return best if best and best[0] > 1e-6 else None


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> list:
    """Trees of depth two by second-order boosting of the logistic loss: (feature, cut, left, right) or a leaf's value."""
    score, trees = np.zeros(len(y)), []

    def grow(rows: np.ndarray, depth: int):
        found = _best_split(x, g, h, rows) if depth and len(rows) > 20 else None
        if found is None:
            return float(-RATE * g[rows].sum() / (h[rows].sum() + 1))
        _, f, cut = found
        left = x[rows, f] <= cut
        return (f, cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        tree = grow(np.arange(len(y)), 2)
        trees.append(tree)
        score += np.array([value(tree, row) for row in x])
    return trees


def value(tree, row) -> float:
    while not isinstance(tree, float):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


def as_column(tree, names: list[str]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, left, right = tree
    return F.when(F.col(names[f]) <= cut, as_column(left, names)).otherwise(as_column(right, names))


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float = LEAST_PRECISION) -> float:
    """The least score, 0.5 at least, from which on that share of the candidates is personal."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal scores are chosen together
    good = np.flatnonzero(last & (share >= precision) & (p[order] >= 0.5))
    if not len(good):
        raise ValueError("no threshold reaches the precision")
    return float(p[order][good[-1]])


def fitted(base: DataFrame) -> dict[str, tuple[list, float, float, float]]:
    """For each sampled kind: trees, calibration (slope, offset of the log-odds) and threshold.

    Carriers are pieces of at most CARRIERS texts, the first by hash. The sample's features are computed by the same
    expressions as those of the candidates. Trees are fitted on one half, calibrated on the other by a logistic fit.
    """
    spark = base.sparkSession
    at = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - CARRIER_CHARS, F.lit(1)))
    piece = F.substr("text", (at + 1).cast("int"), F.lit(CARRIER_CHARS)).alias("piece")
    held = base.filter("text <> ''").select(F.xxhash64(F.lit(3), "id").alias("mark"), "id", piece).orderBy("mark", "id").limit(CARRIERS).collect()
    carriers = sorted(r["piece"] for r in held) or [""]
    sample = spark.createDataFrame(labelled_sample(carriers), "kind string, match string, before string, after string, label int")
    of = features(F.col("match"), F.col("before"), F.col("after"))
    rows = sample.select("kind", "label", *[c.alias(n) for n, c in of.items()]).collect()
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        x = np.array([[r[n] for n in of] for r in own])
        y = np.array([r["label"] for r in own], float)
        fit = np.arange(len(y)) % 2 == 0
        trees = boost(x[fit], y[fit])
        raw = np.array([sum(value(t, row) for t in trees) for row in x[~fit]])
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            d, w = p - y[~fit], p * (1 - p) + 1e-6
            hessian = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
            step = np.linalg.solve(hessian, np.array([(d * raw).sum() + (a - 1), d.sum() + b]))
            a, b = a - step[0], b - step[1]
        # the threshold holds for the log-odds, whose sums SQL and numpy may round apart in the last place
        out[kind] = (trees, float(a), float(b), least_threshold(1 / (1 + np.exp(-(a * raw + b))), y[~fit]) - 1e-9)
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): spans of personal data, (start, rank, kind, end, score, base), by start and kind.

    The rules' spans are all kept (base, score 1). The generators' candidates are scored by boosted trees on format and
    context; those over their kind's calibrated threshold that overlap no base span are added, and may overlap each
    other. Offsets are code points, ends exclusive; spans of one start stand in the order of KINDS. Texts of any length
    are read whole; a match's context is 24 code points. Null texts are empty. Rows without a doc_id are documents of
    their own by their text; rows that share a doc_id count as one, the one of least text. Extra columns are not read.
    An empty table gives no rows.
    """
    base = id_and_text(docs)
    model = fitted(base)
    every = written(matches(base, {**RULES, **GENERATORS}), "matches")
    by_rule, candidates = (every.filter(F.col("kind").isin(*own)) for own in (RULES, GENERATORS))
    passes = F.lit(False)
    for kind in RULES:
        passes = passes | ((F.col("kind") == kind) & _passes(kind, F.col("match")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("rank")
    sure = by_rule.filter(passes).select("id", "kind", rank, F.col("start").cast("long"), F.col("end").cast("long"), F.lit(1.0).alias("score"), F.lit(True).alias("base"))
    of = features(F.col("match"), F.col("before"), F.col("after"))
    names = list(of)
    measured = candidates.select("id", F.col("kind").alias("by"), "start", "end", *[c.alias(n) for n, c in of.items()])
    likely = []
    for by, kinds in KIND_OF.items():
        for kind in kinds:
            trees, a, b, cut = model["abroad" if by == "abroad" else kind]
            raw = sum((as_column(t, names) for t in trees), F.lit(0.0))
            p = 1 / (1 + F.exp(-(F.lit(a) * raw + F.lit(b))))
            likely.append(F.when((F.col("by") == by) & (p >= cut), F.struct(F.lit(kind).alias("kind"), p.alias("score"))))
    chosen = measured.select("id", "start", "end", F.explode(F.filter(F.array(*likely), lambda x: x.isNotNull())).alias("x"))
    added = chosen.select("id", F.col("x.kind").alias("kind"), "start", "end", F.col("x.score").alias("score"))
    added = added.select("id", "kind", rank, F.col("start").cast("long"), F.col("end").cast("long"), "score", F.lit(False).alias("base"))
    # an added span goes if a base span that starts no later ends behind its start, or a later one starts before its end
    order = W.partitionBy("id").orderBy("start", F.col("base").desc())
    until = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    marked = sure.unionByName(added).withColumn("until", until).withColumn("following", following)
    kept = marked.filter(F.col("base") | (F.coalesce(F.col("until") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("following") >= F.col("end"), F.lit(True))))
    span = F.struct("start", "rank", "kind", "end", "score", "base")
    grouped = kept.groupBy("id").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    out = base.join(grouped, "id", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,base:boolean>>")
    return out.select(public_id().alias("doc_id"), "text", F.coalesce("spans", none).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
