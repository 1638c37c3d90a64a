"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans come from four patterns with checks and always stay.  Further candidates are
other written forms: addresses with "at" and "dot" or blanks around the sign, addresses of
hosts with "dot" or bracketed points, card numbers with other separators, telephone numbers
without a plus sign, and secrets (a token, key or password and its value).  On every
candidate, base or not, six labelers vote yes, no or nothing, none of which knows whether it
is a base span: three by regular expression (length, grouping, strict form), one by
gazetteer (endings of mail hosts, calling codes, card issuers) and two by context (words
that announce such data or something else, and what touches the span).
Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability by kind and each pattern's probability; matches of a base pattern that fail its
check are known to be false and keep probability 0.  A logistic span classifier on kind,
form and context is trained on these probabilities.  Candidates that it takes, and that
overlap no base span, are added.

The main path uses DataFrame functions only, and its work grows with the text's length (times
the logarithm of the number of its spans): places are running sums over the pieces between
matches, made by doubling steps.  What reaches the driver are counts of vote and feature
patterns, whose number is bounded by the labelers and features.  A null text counts as empty
and has no spans; texts of any length are searched whole (the patterns have no nested
backtracking); repeated rows give repeated results; an empty table gives an empty result;
columns besides doc_id and text are ignored by the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: The kinds in their order; secrets are no personal data and are told apart.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Patterns with the matches of the base patterns, written so that they need no backtracking:
#: a run of the first character class is entered at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Further forms.
WRITTEN_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"
SPACED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20@\x20?|@\x20)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
WRITTEN_IP = r"(?i)(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:[\[(](?:\.|dot)[\])]|dot)\x20?[0-9]{1,3}+){3}(?![0-9])"
OTHER_CARD = r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
PLAIN_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"
LONG_PHONE = r"(?<![0-9+.-])00[1-9][0-9]?[\x20()-][\x20()0-9-]+[0-9]"
SECRETS = r"(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d)\x20{0,2}[=:]\x20{0,2}\"?[A-Za-z0-9+/_=-]{16,}+"
#: Gazetteers: endings of mail hosts, calling codes and card issuers by their first digits.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "it", "example")
CALLING = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[235689][0-9]{2})"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|60|65)"
#: Words that announce personal data or something else.
ANNOUNCE = r"(?i)\b(?:e-?mail|mail|contact|write|call|phone|tel|telephone|mobile|fax|card|visa|credit|payment|ip|host|server|address|reach|login|auth)\b[^.!?]{0,16}$"
OTHERWISE = r"(?i)(?:\b(?:version|release|page|section|figure|isbn|hash|sha|id|serial|order|number)\b[^.!?]{0,12}|[0-9a-f]{6,})$"
BEFORE, AFTER = 32, 8
LABELERS = 6
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "is_secret", "valid", "many_digits", "separated", "long", "blank_before", "blank_after", "announced", "odd_before", "letters")
#: Steps of a running sum: enough for arrays of 2^30 places; those beyond an array's size are left out.
DOUBLING = ", ".join(str(1 << k) for k in range(30))


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


_LUHN = "aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substring({d}, length({d}) - i + 1, 1) AS int) ELSE element_at(array(0,2,4,6,8,1,3,5,7,9), CAST(substring({d}, length({d}) - i + 1, 1) AS int) + 1) END) % 10 = 0"
_IS_CARD = f"(length({_digits('s.body')}) BETWEEN 12 AND 19 AND {_LUHN.format(d=_digits('s.body'))})"
#: name: (kind, base, pattern, what a text with a match has, check of a match)
FORMS = {
    "email": ("email", True, EMAIL, "contains(text, '@')", "true"),
    "ip": ("ip", True, IP, r"rlike(text, r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]')", "forall(split(s.body, '[.]'), o -> length(ltrim('0', o)) <= 3 AND CAST(concat('0', right(o, 3)) AS int) <= 255)"),
    "card": ("card", True, CARD, r"rlike(text, r'[0-9](?:[\x20-]?[0-9]){11}')", _IS_CARD),
    "phone": ("phone", True, PHONE, "contains(text, '+')", f"length({_digits('s.body')}) BETWEEN 9 AND 15"),
    "written": ("email", False, WRITTEN_EMAIL, r"rlike(text, r'(?i)[\x20)\]]at[\x20)\]]|[(\[]at[)\]]') AND rlike(text, r'(?i)\bdot\b')", f"rlike(s.body, r'[(\\[]') OR rlike(lower(s.body), r'\\x20(?:{'|'.join(ENDINGS)})$')"),
    "spaced": ("email", False, SPACED_EMAIL, "contains(text, ' @') OR contains(text, '@ ')", "true"),
    "worded": ("ip", False, WRITTEN_IP, r"rlike(text, r'(?i)[0-9]\x20?(?:[\[(](?:\.|dot)[\])]|dot)\x20?[0-9]')", "forall(regexp_extract_all(s.body, '[0-9]+', 0), o -> CAST(o AS int) <= 255)"),
    "marked": ("card", False, OTHER_CARD, r"rlike(text, r'[0-9]{4}[._/][0-9]{4}[._/]')", _IS_CARD),
    "plain": ("phone", False, PLAIN_PHONE, r"rlike(text, r'[0-9]{3}[.-][0-9]{4}')", "true"),
    "prefixed": ("phone", False, LONG_PHONE, r"rlike(text, r'(?<![0-9+.-])00[1-9]')", f"length({_digits('s.body')}) BETWEEN 11 AND 17"),
    "secret": (SECRET, False, SECRETS, r"rlike(text, r'(?i)token|secret|key|passw')", "true"),
}


def _running(x: str, step: str) -> str:
    """SQL: running sums (or another associative step of v and u) of an array, by doubling steps."""
    return f"aggregate(filter(array({DOUBLING}), k -> k < size({x})), {x}, (a, k) -> transform(a, (v, i) -> CASE WHEN i >= k THEN {step.format(v='v', u='a[i - k]')} ELSE v END))"


def located(docs: DataFrame) -> DataFrame:
    """docs' columns with text made non-null and, for each form, an array of matches: kind, base,
    ok, start and end in characters, from and upto in bytes, body, and what stands left and right."""
    t = docs.withColumn("text", text_or_empty())
    none = "array()"
    for k, (_, _, pattern, there, _) in FORMS.items():
        p = "r'" + pattern.replace("'", "\\'") + "'"
        t = t.withColumn(f"_m_{k}", F.expr(f"CASE WHEN {there} THEN named_struct('gaps', split(text, {p}, -1), 'bodies', regexp_extract_all(text, {p}, 0)) ELSE named_struct('gaps', CAST({none} AS array<string>), 'bodies', CAST({none} AS array<string>)) END"))
    for k in FORMS:
        of = lambda f: f"zip_with(slice(_m_{k}.gaps, 1, size(_m_{k}.bodies)), _m_{k}.bodies, (g, b) -> {f}(g) + {f}(b))"  # noqa: B023, E731
        t = t.withColumn(f"_c_{k}", F.expr(of("length"))).withColumn(f"_b_{k}", F.expr(of("octet_length")))
    for k in FORMS:
        t = t.withColumn(f"_ce_{k}", F.expr(_running(f"_c_{k}", "{v} + {u}"))).withColumn(f"_be_{k}", F.expr(_running(f"_b_{k}", "{v} + {u}")))
    for k, (kind, base, _, _, _) in FORMS.items():
        m = f"_m_{k}"
        t = t.withColumn(
            f"_s_{k}",
            F.expr(
                f"transform({m}.bodies, (b, i) -> named_struct('kind', '{kind}', 'base', {str(base).lower()}, 'start', _ce_{k}[i] - length(b), 'end', _ce_{k}[i], 'from', _be_{k}[i] - octet_length(b), 'upto', _be_{k}[i], 'body', b, "
                f"'left', right(concat(CASE WHEN i > 0 THEN {m}.bodies[i - 1] ELSE '' END, {m}.gaps[i]), {BEFORE}), 'right', left({m}.gaps[i + 1], {AFTER})))"
            ),
        )
    for k, (_, _, _, _, check) in FORMS.items():
        fields = ", ".join(f"'{c}', s.{c}" for c in ("kind", "base", "start", "end", "from", "upto", "body", "left", "right"))
        t = t.withColumn(k, F.expr(f"transform(_s_{k}, s -> named_struct({fields}, 'ok', coalesce({check}, false)))"))
    return t.select(*docs.columns, *[F.col(k).alias(f"_{k}") for k in FORMS])


def candidates(docs: DataFrame) -> DataFrame:
    """docs' columns with text made non-null, base: base spans, extra: further candidates that overlap
    no base span, and wrong: matches of base patterns that fail their check."""
    t = located(docs)
    bases, others = ([f"_{k}" for k, f in FORMS.items() if f[1] is want] for want in (True, False))
    t = t.withColumn("_base", F.expr(f"filter(concat({', '.join(bases)}), s -> s.ok)")).withColumn("wrong", F.expr(f"filter(concat({', '.join(bases)}), s -> NOT s.ok)"))
    t = t.withColumn("_other", F.expr(f"filter(concat({', '.join(others)}), s -> s.ok)"))
    # sorted by start, a candidate overlaps if a base span before ends behind its start, or one behind starts before its end
    by = "(p, q) -> CASE WHEN p.start <> q.start THEN p.start - q.start WHEN p.base <> q.base THEN CASE WHEN p.base THEN -1 ELSE 1 END ELSE p.end - q.end END"
    t = t.withColumn("_all", F.expr(f"CASE WHEN size(_other) > 0 THEN array_sort(concat(_base, _other), {by}) ELSE slice(_other, 1, 0) END"))
    t = t.withColumn("_until", F.expr("transform(_all, s -> CASE WHEN s.base THEN s.end ELSE -1 END)")).withColumn("_next", F.expr("reverse(transform(_all, s -> CASE WHEN s.base THEN s.start ELSE 2147483647 END))"))
    t = t.withColumn("_before", F.expr(_running("_until", "greatest({v}, {u})"))).withColumn("_after", F.expr(_running("_next", "least({v}, {u})")))
    t = t.withColumn("extra", F.expr("filter(_all, (s, i) -> NOT s.base AND _before[i] <= s.start AND _after[size(_all) - 1 - i] >= s.end)"))
    return t.select(*docs.columns, F.col("_base").alias("base"), "extra", "wrong")


def _vote(yes: str, no: str) -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def votes(s: str = "s") -> dict[str, str]:
    """SQL of each labeler's vote on a span: 1, -1, or 0 for none."""
    d, digits = f"length({_digits(f'{s}.body')})", _digits(f"{s}.body")
    ends = "|".join(ENDINGS)
    kind = lambda k, test: f"({s}.kind = '{k}' AND {test})"
    like = lambda x, p: f"rlike({x}, r'{p}')"
    size = f"length({s}.body)"
    return {
        "v0": _vote(" OR ".join((kind("phone", f"{d} BETWEEN 10 AND 13"), kind("card", f"{d} IN (15, 16)"), kind("email", f"{size} BETWEEN 8 AND 64"), kind("ip", f"{d} BETWEEN 4 AND 12"), kind(SECRET, f"{size} >= 28"))), " OR ".join((kind("phone", f"{d} < 10"), kind("email", f"{size} < 8 OR {size} > 128"), kind("card", f"{d} < 14")))),
        "v1": _vote(" OR ".join((kind("phone", like(f"{s}.body", r"[0-9]{3}[)]?[\x20.-]+[0-9]{3}[\x20.-][0-9]{4}$")), kind("card", like(f"{s}.body", r"^(?:[0-9]{15,16}|[0-9]{4}([^0-9])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$")), kind("email", like(f"{s}.body", r"^[A-Za-z0-9]")))), " OR ".join((kind("phone", like(f"{s}.body", r"[.-]{2}|\x20{2}")), kind("email", like(f"{s}.body", r"[.]{2}"))))),
        "v2": _vote(" OR ".join((kind("ip", "NOT " + like(f"{s}.body", r"(^|[^0-9])0[0-9]")), kind("email", like(f"{s}.body", r"(?i)[a-z][a-z0-9._%+-]*[^a-z0-9]")), kind(SECRET, like(f"{s}.body", r"[0-9].*[a-z]|[a-z].*[0-9]")))), " OR ".join((kind("ip", like(f"{s}.body", r"(^|[^0-9])0[0-9]")), kind(SECRET, "NOT " + like(f"{s}.body", r"[0-9]"))))),
        "v3": _vote(" OR ".join((kind("email", like(f"lower({s}.body)", rf"[.\x20)\]](?:{ends})$")), kind("phone", like(digits, r"^[0-9]") + " AND " + like(f"{s}.body", CALLING)), kind("card", like(digits, ISSUERS)))), " OR ".join((kind("phone", like(f"{s}.body", r"^[+]?0[^0]")), kind("card", like(digits, r"^[01789]"))))),
        "v4": _vote(like(f"{s}.left", ANNOUNCE), like(f"{s}.left", OTHERWISE)),
        "v5": _vote(like(f"{s}.left", r"(^|[\s(,;:|<\"])$") + " AND " + like(f"{s}.right", r"^([\s),;:.!?|>\"]|$)"), like(f"{s}.left", r"[A-Za-z0-9]$") + " OR " + like(f"{s}.right", r"^[A-Za-z0-9]")),
    }


def features(s: str = "s") -> dict[str, str]:
    """SQL of each 0/1 feature of a span's kind, form and surroundings."""
    return {f"is_{k}": f"{s}.kind = '{k}'" for k in (*KINDS, SECRET)} | {
        "valid": f"{s}.ok",
        "many_digits": f"length({_digits(f'{s}.body')}) >= 10",
        "separated": f"rlike({s}.body, r'[\\x20().@-]')",
        "long": f"length({s}.body) > 24",
        "blank_before": f"rlike({s}.left, r'(^|[\\s(,;:|])$')",
        "blank_after": f"rlike({s}.right, r'^([\\s),;:.!?|]|$)')",
        "announced": f"rlike({s}.left, r'{ANNOUNCE}')",
        "odd_before": f"rlike({s}.left, r'{OTHERWISE}')",
        "letters": f"rlike({s}.body, r'[A-Za-z]')",
    }


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], wrong: dict[str, list[tuple[tuple[int, ...], int]]] | None = None, rounds: int = 50) -> tuple[dict, dict[tuple, float]]:
    """EM over counted vote patterns (kind, votes, count): for each kind the prior and each
    labeler's chances of yes, no and nothing on true and on false spans; the probability of
    each pattern.  Starts from the share of yes votes.  ``wrong`` has patterns of spans that are
    known to be false; they count for the false side of their kind."""
    prob = {(k, v): min(0.95, max(0.05, 0.5 + 0.4 * sum(v) / max(1, sum(map(abs, v))))) for k, v, _ in patterns}
    model: dict = {}
    for _ in range(rounds):
        for kind in {k for k, _, _ in patterns}:
            rows = [(v, n, prob[kind, v]) for k, v, n in patterns if k == kind]
            total = sum(n for _, n, _ in rows)
            prior = (sum(n * p for _, n, p in rows) + 1) / (total + 2)
            rows += [(v, n, 0.0) for v, n in (wrong or {}).get(kind, [])]
            table = []
            for i in range(LABELERS):
                # a labeler is taken to be better than chance, by one count each
                true = {x: 1.0 + (x == 1) for x in (-1, 0, 1)}
                false = {x: 1.0 + (x == -1) for x in (-1, 0, 1)}
                for v, n, p in rows:
                    true[v[i]] += n * p
                    false[v[i]] += n * (1 - p)
                table.append(tuple({x: c / sum(t.values()) for x, c in t.items()} for t in (true, false)))
            model[kind] = (prior, table)
        for k, v, _ in patterns:
            prior, table = model[k]
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[x] / f[x]) for (t, f), x in zip(table, v))
            prob[k, v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return model, prob


def train_classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Logistic weights (bias first) from feature patterns with (probability, count)."""
    n = len(FEATURES) + 1
    w = [0.0] * n
    total = sum(c for _, _, c in rows) or 1.0
    # false spans that nothing in the tables shows: a prior count of bare patterns
    rows = [*rows, ((0,) * (n - 1), 0.0, 0.02 * total)]
    total = sum(c for _, _, c in rows)
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for f, p, c in rows:
            x = (1, *f)
            z = sum(a * b for a, b in zip(w, x))
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for i, b in enumerate(x):
                if b:
                    grad[i] += c * (q - p) / total
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def trained(spans: DataFrame) -> list[float]:
    """The classifier's weights from a table with arrays base, extra and wrong."""
    each = spans.select(F.explode(F.concat("base", "extra", "wrong")).alias("s"))
    each = each.select("s.kind", "s.ok", *[F.expr(sql).alias(k) for k, sql in votes().items()], *[F.expr(f"coalesce({sql}, false)").cast("int").alias(k) for k, sql in features().items()])
    names = [f"v{i}" for i in range(LABELERS)]
    counted = each.groupBy("kind", "ok", *names, *FEATURES).count().collect()  # patterns, whose number is bounded
    by_votes: dict[tuple, int] = {}
    wrong: dict[str, list] = {}
    for r in sorted(counted, key=str):
        v = tuple(r[x] for x in names)
        if r["ok"]:
            by_votes[r["kind"], v] = by_votes.get((r["kind"], v), 0) + r["count"]
        else:
            wrong.setdefault(r["kind"], []).append((v, r["count"]))
    _, prob = reliabilities([(k, v, n) for (k, v), n in by_votes.items()], wrong)
    return train_classifier([(tuple(r[f] for f in FEATURES), prob[r["kind"], tuple(r[v] for v in names)] if r["ok"] else 0.0, float(r["count"])) for r in counted])


def found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, base and all: the base spans, and all spans in order of start and kind."""
    spans = candidates(docs)
    weights = trained(materialize(spans.select("base", "extra", "wrong"), "spans"))
    margin = " + ".join([repr(weights[0]), *(f"{w!r} * CAST(coalesce({sql}, false) AS int)" for w, sql in zip(weights[1:], features("x").values()))])
    order = "element_at(map('email', 0, 'ip', 1, 'card', 2, 'phone', 3, 'secret', 4), {0}.kind)"
    by = f"(p, q) -> CASE WHEN p.start <> q.start THEN p.start - q.start WHEN {order.format('p')} <> {order.format('q')} THEN {order.format('p')} - {order.format('q')} ELSE p.end - q.end END"
    slim = "transform({0}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'from', s.from, 'upto', s.upto))"
    spans = spans.withColumn("_added", F.expr(f"filter(extra, x -> {margin} >= 0)"))
    # a filter on the result must not be pushed below: with all columns put in, each would be computed many times
    once = lambda sql: F.expr(f"CASE WHEN rand(0) < 2 THEN {sql} END")
    return spans.select(*keep, once(f"array_sort({slim.format('base')}, {by})").alias("base"), once(f"array_sort({slim.format('concat(base, _added)')}, {by})").alias("all"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans,
    secrets (joined likewise) and n_private, the number of all spans and secrets."""
    rows = found(docs.select("doc_id", "text"), ["doc_id"])
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined(f"filter(all, s -> s.kind <> '{SECRET}')").alias("spans"),
        _joined(f"filter(all, s -> s.kind = '{SECRET}')").alias("secrets"), F.size("all").cast("long").alias("n_private"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each personal span and secret of text replaced by its kind in brackets; of spans that
    overlap, the first names the joint place.  Null texts stay null."""
    rows = found(docs.select(F.struct(*docs.columns).alias("given"), "text"), ["given", "text"])
    rows = rows.withColumn("_ends", F.expr("transform(all, s -> s.upto)"))
    rows = rows.withColumn("_done", F.expr(_running("_ends", "greatest({v}, {u})"))).withColumn("_bytes", F.col("text").cast("binary"))
    piece = "CASE WHEN i = 0 OR s.from >= _done[i - 1] THEN concat(decode(substring(_bytes, CASE WHEN i = 0 THEN 1 ELSE _done[i - 1] + 1 END, s.from - CASE WHEN i = 0 THEN 0 ELSE _done[i - 1] END), 'UTF-8'), '[', upper(s.kind), ']') ELSE '' END"
    text = F.expr(f"CASE WHEN given.text IS NULL THEN NULL WHEN size(all) = 0 THEN text ELSE concat(array_join(transform(all, (s, i) -> {piece}), ''), decode(substring(_bytes, _done[size(all) - 1] + 1), 'UTF-8')) END")
    return rows.select(*[text.alias(c) if c == "text" else F.col("given")[c].alias(c) for c in docs.columns])
