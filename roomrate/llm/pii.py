"""PII (7): weak-supervision aggregation. Column expressions, SQL and Spark ML only.

Candidates are spans of the four base kinds (email, ip, card, phone) and of wider ones: iban, key (headers of private
keys, tokens of known issuers), identity (numbers after words for papers), birth (dates after words for births), address,
name (after titles and words for persons), password, number (other runs of 7 to 19 digits), secret (long values after
= or :). Four labelers vote on each candidate, for (1), against (-1) or not at all (0):

* regex      a strict form of the kind
* checksum   Luhn for 13 to 19 digits, remainders by 97 for IBANs, ranges of parts for addresses and dates
* gazetteer  top-level domains, calling codes, card issuers, reserved address blocks, countries, given names, streets
* context    words to the left that speak of contacts, persons and payments, or of versions, pages and prices

Expectation-maximisation over the counts of vote patterns (a bounded table: kinds x votes) estimates each labeler's
reliability for each kind and each pattern's probability; base spans are known to be personal and hold their class. A
prior of PRIOR of a kind's candidates holds each labeler to be more often right than wrong, so that a pattern means about
the same in a small table as in a large one. These soft labels train the span classifier, a logistic regression over
votes, length, share of digits and the character to the right, each by kind; all patterns of a kind weigh by the square root
of their count, and all kinds alike, so that frequent ones do not decide for rare ones. Its coefficients
score every candidate in a column expression. Candidates scored above one half that overlap no base span are added, of
overlapping ones the one with the highest score; base spans always stay.

Patterns are written so that no text makes them slow: quantifiers are possessive, and a match is only tried
where a run of its first characters begins. Positions come from the lengths of the matches and of the parts
between them, in code points.

Defined results: null text counts as empty; a null id passes through; repeated rows stay; texts without
candidates have empty strings of spans; without any candidate in the table nothing is trained or added;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrate.llm.storage import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "key", "identity", "birth", "address", "name", "password", "number", "secret")
#: share of a kind's candidates that the prior of the labelers' reliabilities counts for, and candidates it counts for at least
PRIOR, PRIOR_LEAST = 0.2, 20.0
#: prior probability of each vote on personal and on other spans
VOTES = {1: (0.6, 0.1), 0: (0.3, 0.4), -1: (0.1, 0.5)}
LABELERS = ("regex", "checksum", "gazetteer", "context")

_LOCAL = "[A-Za-z0-9._%+-]"
_MONTH = ("(?:jan|feb|m[aä]r|apr|ma[iy]|jun|jul|aug|sep|o[ck]t|nov|de[cz]|enero|febrero|marzo|abril|junio|julio|janvier|février|avril|"
          "juin|juillet|août)\\p{L}{0,7}+")
_PART = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
    "key": (r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|"
            r"[spr]k_(?:live|test)_[0-9A-Za-z]{10,}+|gh[pousr]_[0-9A-Za-z]{20,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{30,}+|"
            r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"),
    "identity": (r"(?=[A-Z0-9])(?<![0-9A-Za-z])(?<=(?i:passport|ssn|social security|national id|identity card|id card|driver'?s licen[cs]e|tax id|nino|dni|personalausweis)"
                 r"(?: [Nn]umber| [Nn]o\.?| [Nn]r\.?| #)?(?: is)?[ \t]{0,2}[:#=]?[ \t]{0,2})"
                 r"[A-Z]{0,3}[0-9][0-9A-Z]{0,11}+(?:[ -][0-9]{2,6}){0,3}+(?:[ -]?[A-Z])?+(?![0-9A-Za-z])"),
    "birth": (r"(?i)(?=[0-9])(?<![0-9])(?<=(?:born|birth|birthday|dob|geboren|geburtsdatum|nacid[oa]|nacimiento|naissance|née|né)[^\n0-9]{0,16})(?:[0-9]{1,2}([./-])"
              rf"[0-9]{{1,2}}\1(?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}\.?(?: de)? {_MONTH}(?: de)? [0-9]{{4}})(?![0-9])|"
              rf"(?=[adefjmnos])(?<!\p{{L}})(?={_MONTH} [0-9])(?<=(?:born|birth|birthday|dob)[^\n0-9]{{0,16}}){_MONTH} [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}(?![0-9])"),
    "address": (r"(?<![0-9A-Za-z.,])[0-9]{1,5}[A-Za-z]?,? (?:(?:[A-Z][\p{L}'.]{0,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|"
                r"Blvd|Court|Ct|Way|Terrace|Close|Crescent)(?![\p{L}])|(?:rue|avenue|boulevard|chemin)(?: d[eu]s?| la| l'| les){0,2} ?[A-Z]\p{L}{1,20}+)|"
                r"(?<!\p{L})[A-Z]\p{L}{1,20}(?:straße|strasse|gasse|allee|platz|weg) [0-9]{1,4}[a-z]?(?![0-9\p{L}])|"
                r"(?<!\p{L})(?:Calle|Avenida|Via|Plaza) (?:de )?(?:la )?[A-Z]\p{L}{1,20}+,? [0-9]{1,4}(?![0-9])"),
    "name": (r"(?=[A-Z])(?<=[ \t])(?<=(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sra?|Señora?|[Nn]ame|[Nn]amed|NAME|[Pp]atient|[Cc]ustomer|"
             r"[Ee]mployee|[Rr]ecipient|[Ss]igned|[Cc]ontact)(?:\.|:| is|=)?[ \t]{1,2})[A-Z][\p{Ll}'-]{1,20}+(?: [A-Z]\.)?+(?: [A-Z][\p{Ll}'-]{1,20}+){0,2}+(?!\p{L})"),
    "password": r"(?<=[:= \t\"'])(?=[^\s\"':=])(?<=(?i:password|passwd|pwd|passwort|contraseña|mot de passe)(?: is)?[ \t]{0,2}[:=][ \t]{0,2}[\"']?)[^\s\"':=]{4,64}+",
    "number": r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
    "secret": r"(?<=[=:][ \t]{0,2}[\"']?)(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
#: a text without this cannot hold the kind
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]",
         "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "key": "PRIVATE KEY-----|A[KS]IA|k_(?:live|test)_|gh[pousr]_|xox|AIza|eyJ",
         "identity": "(?i)passport|ssn|social security|national id|identity card|id card|licen[cs]e|tax id|nino|dni|personalausweis",
         "birth": "(?i)born|birth|dob|geboren|geburtsdatum|nacid|nacimiento|naissance|né", "address": r"[0-9]{1,5}[A-Za-z]?,? \p{L}|\p{L},? [0-9]",
         "name": r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sra?|Señora?|ame|amed|NAME|atient|ustomer|mployee|ecipient|igned|ontact)[.:=]?(?: is)?[ \t]{1,2}[A-Z]",
         "password": "(?i)password|passwd|pwd|passwort|contraseña|mot de passe",
         "number": "[0-9](?:[ ().-]{0,2}[0-9]){6}", "secret": r"[=:][ \t]{0,2}[\"']?[A-Za-z0-9+/_-]{16}"}

STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(\.[A-Za-z0-9][A-Za-z0-9-]*)*\.[A-Za-z]{2,}$",
    "ip": rf"^{_PART}(\.{_PART}){{3}}$",
    "card": r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5}$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)[ .-]?)?[0-9]+([ .-][0-9]+)*$",
    "number": r"^[0-9]{13,19}$|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\(?0[0-9]{1,4}\)?[ -][0-9]{3,4}[ -]?[0-9]{3,4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}( [A-Z0-9]{4})+( [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "key": "^.",
    "identity": r"^[A-Z]{0,3}[0-9][0-9A-Z]{5,11}$|^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$|^[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-Z]$",
    "birth": "^.",
    "address": "^.",
    "name": r"^\S+( [A-Z]\.)? \S+",
    "password": r"[0-9!-/:-@]",
    "secret": r"^[0-9a-f]{32,}$|^[A-Z0-9]{20,}$|^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{24,}$",
}
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|us|eu|ch|at|nl)$",
    "ip": None,
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "number": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)[0-9]{11,18}$",
    "iban": (r"^(AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|"
             r"LT|LU|LV|LY|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK)"),
    "key": "^.",
    "identity": None,
    "birth": "(19|20)[0-9]{2}",
    "address": r"(?i)(street|avenue|road|lane|drive|boulevard|straße|strasse|gasse|allee|rue|calle|avenida)",
    "name": (r"^(James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|George|Peter|"
             r"Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Lisa|Nancy|Anna|Emma|Laura|Julia|Maria|Alice|Jane|"
             r"Hans|Peter|Klaus|Jürgen|Wolfgang|Ursula|Monika|Sabine|Petra|Jean|Pierre|Michel|Philippe|Marie|Nathalie|Isabelle|Sophie|"
             r"José|Juan|Antonio|Manuel|Francisco|Carlos|Luis|Carmen|Ana|Isabel|Wei|Li|Mohammed|Ahmed|Fatima|Priya|Raj|Alex|Sam|Chris) "),
    "password": None,
    "secret": r"^(sk|pk|ghp|gho|xox[abp]|AKIA|AIza|eyJ)",
}
RESERVED_IP = r"^(0|127|255|22[4-9]|23[0-9])\."
CONTEXT_FOR = (r"(?i)(e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|iban|account|ssn|passport|address|host|server|"
               r"login|token|secret|key|password|passwd|pwd|name|mrs?|ms|dr|herr|frau|patient|customer|born|birth|dob|passport|licen[cs]e|security|lives? (?:at|in)|resid|deliver|ship|correo|tarjeta|karte|konto|courriel|carte)[^\n]{0,12}$")
CONTEXT_AGAINST = r"(?i)(version|page|isbn|issn|price|usd|eur|no\.|chapter|section|figure|table|item|sku|build|year)[^\n]{0,6}$"

_SPAN = "array<struct<lo:int,hi:int,hit:string>>"


def spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of the kind's pattern as (lo, hi, hit), in code points."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(hits)), hits,
                       lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("n"), hit.alias("hit")))
    walked = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(
            (s["at"] + x["gap"]).alias("lo"), (s["at"] + x["gap"] + x["n"]).alias("hi"), x["hit"].alias("hit")))).alias("out")),
        lambda s: s["out"])
    return F.when(text.rlike(NEEDS[kind]), walked).otherwise(F.array().cast(_SPAN))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def value(i):
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def by_97(iban: Column) -> Column:
    """The remainder by 97 of an IBAN: its first four characters go last, letters count from 10."""
    turned = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(turned, F.lit(5)), F.substr(turned, F.lit(1), F.lit(4)))

    def step(total, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), step)


def valid(hit: Column, kind: str) -> Column:
    """The base kinds' conditions on a match."""
    n = F.char_length(digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^0*{_PART}(\.0*{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(hit))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def shaped(hit: Column, kind: str) -> Column:
    """Whether a match that fails the conditions is still a candidate: runs of digits too short or too long for a
    card or a phone number are none."""
    n = F.char_length(digits(hit))
    if kind == "identity":
        return F.char_length(F.regexp_replace(hit, "[ -]", "")) >= 6
    return n.between(13, 19) if kind == "card" else n.between(7, 15) if kind == "phone" else F.lit(True)


def votes(text: Column, span: Column, kind: str) -> list[Column]:
    """The labelers' votes on a span, and the classifier's other features."""
    hit, number = span["hit"], digits(span["hit"])
    left = F.substring(text, F.greatest(span["lo"] - 39, F.lit(1)), F.least(span["lo"], F.lit(40)))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    n = F.char_length(number)
    regex = vote(hit.rlike(STRICT[kind]), F.lit(True))
    if kind in ("card", "number"):
        passes = F.when(n.between(13, 19), luhn(number)).otherwise(F.lit(False))
        checksum = vote(passes, n.between(13, 19))
    elif kind == "ip":
        checksum = vote(valid(hit, "ip"), F.lit(True))
    elif kind == "iban":
        checksum = vote(by_97(hit) == 1, F.lit(True))
    elif kind == "birth":
        parts = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
        checksum = vote(F.forall(parts, lambda p: p.cast("int").between(1, 31) | p.cast("int").between(1900, 2030) | (F.char_length(p) == 2)), F.lit(True))
    else:
        checksum = F.lit(0)
    if kind == "ip":
        gazetteer = vote(F.lit(False), hit.rlike(RESERVED_IP))
    else:
        gazetteer = F.lit(0) if GAZETTEER[kind] is None else vote(
            (number if kind in ("card", "number") else hit).rlike(GAZETTEER[kind]), F.lit(kind in ("email", "card", "iban")))
    context = vote(left.rlike(CONTEXT_FOR), left.rlike(CONTEXT_AGAINST))
    size = F.char_length(hit)
    right = F.substring(text, span["hi"] + 1, F.lit(1))
    return [regex.alias("regex"), checksum.alias("checksum"), gazetteer.alias("gazetteer"), context.alias("context"),
            F.when(size < 12, 0).when(size < 20, 1).when(size < 33, 2).otherwise(3).alias("length"),
            F.when(n == 0, 0).when(2 * n < size, 1).when(n < size, 2).otherwise(3).alias("digits"),
            F.when(right.rlike(r"[\p{L}0-9]"), 1).when(right.rlike(r"^[\s.,;:!?)\"']?$"), 0).otherwise(2).alias("right")]


def spotted(docs: DataFrame) -> DataFrame:
    """(id, base, candidates) of every row of docs (id, text)."""
    found = docs.select("id", "text", *[spans(F.col("text"), k).alias(k) for k in KINDS])
    text = F.col("text")

    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["lo"].alias("lo"), s["hi"].alias("hi"),
                                                    *votes(text, s, kind), valid(s["hit"], kind).alias("valid"), shaped(s["hit"], kind).alias("shaped")))

    each = found.select("id", *[labelled(k).alias(k) for k in KINDS])
    return each.select("id", F.concat(*[F.filter(k, lambda c: c["valid"]) for k in BASE]).alias("base"),
                       F.concat(*[F.filter(k, lambda c: ~c["valid"] & c["shaped"]) for k in BASE],
                                                          *[F.filter(k, lambda c: c["shaped"]) for k in KINDS[len(BASE):]]).alias("others"))


def reliabilities(patterns: list[dict], rounds: int = 200) -> list[float]:
    """Probability of each pattern of one kind (votes and count n) by expectation-maximisation over two classes whose
    labelers vote independently, from the prior; the majority of the votes is the start. Patterns that are `known` stay at 1."""
    weight = [p["n"] for p in patterns]
    every = sum(weight)
    prior = PRIOR_LEAST + PRIOR * every
    post = [1.0 if p.get("known") else min(0.9, max(0.1, 0.5 + 0.2 * sum(p[x] for x in LABELERS))) for p in patterns]
    for _ in range(rounds):
        total = sum(w * q for w, q in zip(weight, post, strict=True))
        share = (total + prior / 2) / (every + prior)
        table = {}
        for x in LABELERS:
            for v, (in_yes, in_no) in VOTES.items():
                yes = sum(w * q for p, w, q in zip(patterns, weight, post, strict=True) if p[x] == v)
                no = sum(w * (1 - q) for p, w, q in zip(patterns, weight, post, strict=True) if p[x] == v)
                table[x, v] = math.log((yes + prior * in_yes) / (total + prior)) - math.log((no + prior * in_no) / (every - total + prior))
        logit = [math.log(share / (1 - share)) + sum(table[x, p[x]] for x in LABELERS) for p in patterns]
        new = [1.0 if p.get("known") else 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for p, z in zip(patterns, logit, strict=True)]
        moved = max(abs(a - b) for a, b in zip(new, post, strict=True))
        post = new
        if moved < 1e-9:
            break
    return post


#: features of the classifier: (column, least value, number of values), each by kind
FEATURES = (*((x, -1, 3) for x in LABELERS), ("length", 0, 4), ("digits", 0, 4), ("right", 0, 3))


def classifier(candidates: DataFrame) -> tuple[float, list[list[float]]] | None:
    """(intercept, coefficients of each feature by kind and value) of the span classifier."""
    columns = ["kind", *[x for x, _, _ in FEATURES], "known"]
    patterns = [r.asDict() for r in candidates.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns).collect()]
    if not patterns:
        return None
    first = [0]
    for _, _, values in FEATURES:
        first.append(first[-1] + len(KINDS) * values)
    rows = []
    for kind in sorted({p["kind"] for p in patterns}):
        own = [p for p in patterns if p["kind"] == kind]
        votes = {}
        for p in own:
            key = (*[p[x] for x in LABELERS], p["known"])
            votes[key] = votes.get(key, 0) + p["n"]
        told = [dict(zip((*LABELERS, "known"), key, strict=True)) | {"n": n} for key, n in votes.items()]
        post = dict(zip(votes, reliabilities(told), strict=True))
        scale = sum(math.sqrt(p["n"]) for p in own)
        for p in own:
            at = [f + kind * values + p[x] - least for f, (x, least, values) in zip(first, FEATURES, strict=False)]
            x, q = Vectors.sparse(first[-1], at, [1.0] * len(at)), post[(*[p[x] for x in LABELERS], p["known"])]
            rows += [(x, y, w * math.sqrt(p["n"]) / scale) for y, w in ((1.0, q), (0.0, 1 - q)) if w > 0]
    table = candidates.sparkSession.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1)
    model = LogisticRegression(weightCol="weight", regParam=1e-4, standardization=False, maxIter=200).fit(table)
    found = [float(c) for c in model.coefficients]
    return model.intercept, [found[lo:hi] for lo, hi in zip(first, first[1:], strict=False)]


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = written(spotted(rows), "pii")
    free = F.filter("others", lambda c: ~F.exists("base", lambda b: (b["lo"] < c["hi"]) & (c["lo"] < b["hi"])))
    table = table.withColumn("others", free)
    known = table.select(F.explode("base").alias("c")).select("c.*", F.lit(True).alias("known"))
    weights = classifier(known.union(table.select(F.explode("others").alias("c")).select("c.*", F.lit(False).alias("known"))))

    def score(c: Column) -> Column:
        intercept, tables = weights
        return sum((F.element_at(F.array(*[F.lit(w) for w in table]), (c["kind"] * values + c[x] - least + 1).cast("int"))
                    for table, (x, least, values) in zip(tables, FEATURES, strict=True)), F.lit(intercept))

    scored = F.transform("others", lambda c: F.struct(c["kind"].alias("kind"), c["lo"].alias("lo"), c["hi"].alias("hi"),
                                                      (F.lit(-1.0) if weights is None else score(c)).alias("score")))
    added = F.filter(scored, lambda c: c["score"] > 0)
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(array) -> Column:
        return F.array_join(F.transform(array, lambda c: F.concat_ws(":", names[c["kind"]], c["lo"], c["hi"])), ",")

    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == BASE.index(k))).cast("long").alias(f"n_{k}")
    # of overlapping spans the one with the highest score is added, then the first kind
    better = lambda o, c: (o["score"] > c["score"]) | ((o["score"] == c["score"]) & (o["kind"] < c["kind"]))
    fresh = F.filter("added", lambda c: ~F.exists("added", lambda o: better(o, c) & (o["lo"] < c["hi"]) & (c["lo"] < o["hi"])))
    place = lambda c: F.struct(c["kind"].alias("kind"), c["lo"].alias("lo"), c["hi"].alias("hi"))
    every = F.array_sort(F.concat(F.transform("base", place), F.transform(fresh, place)))
    return (table.withColumn("added", added)
            .select(F.col("id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"),
                    joined(every).alias("spans")))
