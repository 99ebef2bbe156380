"""Secret scan: candidates by expression, false positives removed by a random forest.

Candidates are values assigned to telling names, tokens with a known prefix, key blocks and long runs with a
digit. A candidate's features (length, character transitions, dictionary coverage, path, neighbouring words and
a few more) are made by DataFrame functions within the row, and the forest is compiled to one expression over
them, so no row leaves its partition. The forest is trained here, on labelled findings written by
``labelled_findings`` from a seed: texts with a marked value and whether it is a secret.

Only DataFrame functions run on the rows. Numpy trains on the features of the labelled findings, a table of a
fixed size, on the driver.

Defined cases: null or empty text has no findings; texts are read whole, and values have no greatest length;
equal values are each a finding at their place; repeated rows are scanned each; extra columns stay and never
clash in ``redacted`` and are ignored in ``scan``; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import only

NAMES = "token|secret|passwd|password|pwd|passphrase|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?key|credentials?|bearer"
KNOWN = (
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|"
    r"sk_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?s:.*?)-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|"
    r"(?:\s+(?:[A-Z][A-Za-z-]*+: [^\n]*|[A-Za-z0-9+/=]{16,}+))++)"
)
#: What leads to a value: a telling name, alone or within a longer one, and a sign or the word ``is``; a bearer; a user in
#: a URL. A quoted value goes on to its quote, blanks and all.
_NAMED = rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]*?(?i:{NAMES})[A-Za-z0-9_-]*+[\"']?[ \t]*(?::=|=>|[:=]|(?<=[ \t])is(?=[ \t]))[ \t]*"
_BEARER, _USER = r"(?i:\bbearer)[ \t]++", r"\b(?i:[a-z][a-z0-9+.-]{1,15}+://)[^\s:/@\"']{0,64}:"
LEAD = f"{_NAMED}[\"']?|{_BEARER}|{_USER}"
ASSIGNED = (
    rf"{_NAMED}(?:\"[^\"\n]{{8,200}}(?=\")|'[^'\n]{{8,200}}(?=')|[\"']?[^\s\"',;<>]{{8,}}+)|"
    rf"{_BEARER}[A-Za-z0-9._~+/-]{{16,}}+=*+|{_USER}[^\s/@\"']{{4,128}}(?=@)"
)
#: A run that names nothing; what stands before a sign is not part of it.
LONG_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{32,}+=*+"
CANDIDATE = f"{KNOWN}|{ASSIGNED}|{LONG_RUN}"
COMMON = (
    "the|and|for|you|your|this|that|with|from|have|test|example|sample|dummy|change|fake|demo|default|null|none|true|false|user|name|admin|pass|word|secret|"
    "token|key|api|my|here|insert|value|string|replace|todo|xxx|placeholder|data|file|path|config|env|get|set|var|local|host|http|com|org|www|lib|usr|home|src|bin"
)
MASK = "[secret]"
THRESHOLD = 0.5
FEATURES = (
    "length", "transitions", "coverage", "distinct", "digits", "hex", "vowels", "assigned", "known", "quoted", "slashes", "dots", "path_before", "benign_before", "secret_before", "benign_after"
)


def _features(v: Column, hit: Column, left: Column, right: Column) -> list[Column]:
    """The features of a value v within its match, with the text to either side."""
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    gone = lambda pattern: (F.length(v) - F.length(F.regexp_replace(v, pattern, ""))) / n
    yes = lambda c: c.cast("double")
    near = F.right(left, F.lit(40))
    return [
        F.length(v).cast("double"),
        (F.size(F.regexp_extract_all(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))) - 1) / n,
        gone(f"(?i){COMMON}"),
        F.size(F.array_distinct(F.split(F.left(v, F.lit(64)), ""))) / F.least(n, F.lit(64.0)),
        gone("[0-9]"),
        yes(v.rlike("^[0-9a-fA-F]+$")),
        gone("(?i)[aeiou]"),
        yes(hit.rlike(f"^(?:{ASSIGNED})")),
        yes(v.rlike(f"^(?:{KNOWN})")),
        yes(F.concat(hit, F.left(right, F.lit(1))).rlike("[\"'][^\"']*[\"']$")),
        gone("/") * n,
        gone(r"\.") * n,
        yes(near.rlike(r"[\w.-]+/$|https?:\S*$")),
        yes(near.rlike(r"(?i)(commit|revision|sha-?\d*|md5|digest|checksum|hash|etag|uuid|guid|example|sample|dummy|placeholder|integrity|build)\W{0,4}\w{0,3}\W{0,3}$")),
        yes(F.concat(near, hit).rlike(rf"(?i)({NAMES})")),
        yes(F.left(right, F.lit(24)).rlike(r"(?i)^\W{0,3}(example|placeholder|dummy|is an? hash|checksum|\.(js|css|png|jpg|html|json|txt|py|zip|gz))")),
    ]


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``_gaps`` (text before, between and after) and ``_found``, an array of candidates with features.
    Texts without a candidate have null in both."""
    t = F.col(text)
    d = docs.withColumn("_some", t.rlike(CANDIDATE))
    d = d.withColumn("_gaps", F.when(F.col("_some"), F.split(text, CANDIDATE, -1)))
    d = d.withColumn("_hits", F.when(F.col("_some"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))).drop("_some")
    head = F.expr("slice(_gaps, 1, size(_hits))")
    tail = F.expr("slice(_gaps, 2, size(_hits))")
    trios = F.zip_with(F.zip_with(head, "_hits", lambda g, h: F.struct(g.alias("left"), h.alias("hit"))), tail, lambda x, r: F.struct(x["left"].alias("left"), x["hit"].alias("hit"), r.alias("right")))
    value = lambda x: F.when(x["hit"].rlike(f"^(?:{KNOWN})"), x["hit"]).otherwise(F.regexp_extract(x["hit"], rf"^(?:{LEAD})?(.*)$", 1))
    d = d.withColumn("_found", F.transform(trios, lambda x: F.struct(value(x).alias("value"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right"))))
    row = lambda x: F.struct(x["value"].alias("value"), x["hit"].alias("hit"), F.length(x["left"]).alias("gap"), *[f.alias(n) for n, f in zip(FEATURES, _features(x["value"], x["hit"], x["left"], x["right"]))])
    return d.withColumn("_found", F.transform("_found", row)).drop("_hits")


WORDS = "correct horse battery staple river orange window candle mountain silver garden pencil rocket winter bridge falcon marble velvet copper island lantern puzzle thunder walnut".split()


def labelled_findings(n: int = 2400, seed: int = 7) -> list[tuple[str, int]]:
    """(text with one candidate, 1 for a secret): n texts made from a seed, half of them secrets."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = "the ing er on an re ha th ti or en st ed nd to it le is ou ar as de rt ve".split()
    word = lambda a=1, b=4: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 8)))
    name = lambda: r.choice("token secret password api_key apikey access_key passwd client_key auth_key credential SECRET_KEY DB_PASSWORD AWS_SECRET_ACCESS_KEY GITLAB_TOKEN db_password_prod stripe_api_key_live".split())
    link = lambda: r.choice((" = ", "=", ": ", " := ", "="))
    quote = lambda v: (lambda q: q + v + q)(r.choice(('"', '"', "'", "")))
    head = lambda: r.choice(("", "", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + pick(hexa, 32).upper() + "\n"))

    def key_block() -> str:
        kind = r.choice(("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"))
        end = f"\n-----END {kind}-----" if r.random() < 0.8 else ""  # a text can be cut off
        return f"-----BEGIN {kind}-----{head()}\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(3, 26))) + end

    out = []
    for i in range(n):
        if i % 2:
            v = r.choice((pick(hexa, r.choice((32, 40, 40, 48, 64))), pick(alnum, r.randint(20, 64)), pick(alnum + "+/", 40) + "==", pick(alnum + "!@#$%^&*-_", r.randint(10, 24)), pick(alnum + "-_", 43), pick(alnum + "+/", r.randint(100, 1600))))
            known = ("AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), "sk_live_" + pick(alnum, 24), "AIza" + pick(alnum, 35), "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 43), "glpat-" + pick(alnum, 20), key_block())
            form = r.random()
            user = f"{r.choice(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{word()}:{pick(alnum + '!$%^&*_', r.randint(9, 24))}@{word()}.{r.choice(('com', 'net', 'internal'))}/{word()}"
            phrase = f'{name()}{link()}"{" ".join(r.choice(WORDS) for _ in range(r.randint(4, 6)))}"'
            said = f"{r.choice(('password', 'passphrase', 'token', 'secret'))} is {pick(alnum + '!@#$%^&*-_', r.randint(12, 20))}"
            bearer = f"Authorization: Bearer {pick(alnum + '-._', r.randint(24, 60))}"
            hit = r.choice((user, phrase, said, bearer)) if form < 0.2 else name() + link() + quote(v) if form < 0.65 else r.choice(known) if form < 0.85 else f"Authorization: Bearer: {pick(alnum, 40)}" if form < 0.9 else f"{name()} {word()} {pick(alnum + '+/', 44)}"
            out.append((f"{prose()} {hit} {prose()}", 1))
        else:
            holder = r.choice(("your_token_here", "changeme123", "<insert-key>value", "xxxxxxxxxxxxxxxx", "example_password", "${SECRET_VALUE}", "os.environ.get(KEY)", "process.env.API_KEY", "test-password", "null_or_none", "aaaaaaaaaaaa", "****************", "dummy_secret_key", "placeholder", "config.get_token()", "replace_me_please", word(3, 5), word(4, 6) + "1"))
            benign = (
                f"{r.choice(('commit', 'revision', 'sha1', 'md5', 'checksum', 'digest', 'etag', 'hash'))}{link()}{pick(hexa, r.choice((32, 40, 64)))}",
                f"sha512-{pick(alnum + '+/', 86)}==",
                "/".join(word(1, 3) for _ in range(r.randint(4, 7))) + f"/{word()}{r.randint(1, 9)}/{word(2, 5)}",
                f"https://{word(2, 4)}.com/{'/'.join(word(1, 3) for _ in range(5))}/{r.randint(1, 99)}/{word(3, 6)}-{word(2, 4)}",
                f"uuid {pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-a{pick(hexa, 3)}-{pick(hexa, 12)}",
                "_".join(word(2, 4) for _ in range(5)) + f"_{r.randint(1, 99)}_{word(4, 6)}",
                "=" * r.randint(33, 60) + str(r.randint(1, 9)) + "-" * 8,
                f"{word(8, 12)}{r.randint(1, 9)}{word(8, 12)}",
                "".join(str(r.randint(0, 9)) for _ in range(r.randint(33, 60))),
                f"{r.choice(('password', 'token', 'secret', 'passphrase'))} is {r.choice(('required', 'incorrect', 'optional', 'generated', 'validated', 'something', 'displayed', 'encrypted', 'different', 'forgotten'))}",
                f"{r.choice(('https', 'postgres', 'mysql'))}://{r.choice(('user:password', 'username:password', 'admin:changeme', 'user:example', 'root:placeholder'))}@{r.choice(('localhost', 'example.com', 'host'))}/{word()}",
                f"Bearer {r.choice(('your_access_token_here', 'example-token-value', 'placeholder-token-string', 'insert_your_token_here'))}",
                f'{name()}{link()}"{r.choice(("enter your password here", "insert the api key here", "your secret goes here", "replace with your own value", "set in the environment file"))}"',
            )
            hit = name() + link() + quote(holder) if r.random() < 0.45 else r.choice(benign)
            out.append((f"{prose()} {hit} {prose()}", 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 4):
    """A tree as nested (feature, cut, left, right) or a leaf's share of secrets, split by Gini impurity."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return round(float(y.mean()), 4)
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None, None)
    for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        k = k[(v[1:] > v[:-1]) & (k >= least) & (k <= len(y) - least)]
        if len(k):
            a, b = ones[k - 1], ones[-1] - ones[k - 1]
            cost = 2 * (a * (k - a) / k + b * (len(y) - k - b) / (len(y) - k))
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (cost[i], int(f), float((v[k[i] - 1] + v[k[i]]) / 2))
    _, f, cut = best
    if f is None:
        return round(float(y.mean()), 4)
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 6, seed: int = 11) -> list:
    """Bootstrapped trees over feature rows x with labels y."""
    rng = np.random.default_rng(seed)
    return [_grow(x[i], y[i].astype(float), rng, depth) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def _score(tree, of: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(of[FEATURES[f]] <= cut, _score(low, of)).otherwise(_score(high, of))


@lru_cache(maxsize=8)
def _trained(findings: tuple, trees: int, depth: int) -> tuple:
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(findings), "text string, secret int")
    rows = with_candidates(df, "text").select("secret", F.explode("_found").alias("f")).select("secret", *[F.col("f")[n] for n in FEATURES]).collect()  # as many as findings were given
    a = np.array([list(r) for r in rows], float)
    return tuple(grow_forest(a[:, 1:], a[:, 0], trees, depth))


def forest(findings: list[tuple[str, int]] | None = None, trees: int = 16, depth: int = 6) -> tuple:
    """The forest trained on labelled findings; a bounded table, by default that of ``labelled_findings``."""
    return _trained(tuple(findings or labelled_findings()), trees, depth)


def _scored(docs: DataFrame, text: str, trees: tuple) -> DataFrame:
    score = lambda x: sum((_score(t, x) for t in trees[1:]), _score(trees[0], x)) / len(trees)
    d = with_candidates(docs, text)
    return d.withColumn("_found", F.transform("_found", lambda x: F.struct(x["value"].alias("value"), x["hit"].alias("hit"), x["gap"].alias("gap"), score(x).alias("score"))))


def scan(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, trees: tuple | None = None) -> DataFrame:
    """(key, finding, start, length, value, score): the candidates judged secrets, numbered within a row from 0
    over all candidates; start and length in characters."""
    d = _scored(only(docs, key, "text"), "text", trees or forest()).where("_found is not null").select(key, "_found")
    empty = F.expr("cast(array() as array<int>)")
    ends = F.aggregate(
        "_found",
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, x: F.struct((s["at"] + x["gap"] + F.length(x["hit"])).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"] + F.length(x["hit"]))).alias("out")),
        lambda s: s["out"],
    )
    rows = d.select(key, F.posexplode(F.arrays_zip(F.col("_found").alias("f"), ends.alias("e"))).alias("finding", "x"))
    f = F.col("x")["f"]
    return rows.select(  # a value ends where its match ends
        key, "finding", (F.col("x")["e"] - F.length(f["value"])).cast("long").alias("start"), F.length(f["value"]).cast("long").alias("length"), f["value"].alias("value"), F.round(f["score"], 6).alias("score")
    ).where(F.col("score") >= threshold)


def redacted(docs: DataFrame, mask: str = MASK, threshold: float = THRESHOLD, trees: tuple | None = None, length: str | None = None) -> DataFrame:
    """docs, all rows and columns, with every secret in ``text`` replaced by the mask; ``length`` names a column
    of text lengths, made anew where the text changes."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    d = _scored(docs.toDF(*names), names[at], trees or forest())
    hidden = lambda x: F.when(x["score"] >= threshold, F.concat(F.left(x["hit"], F.length(x["hit"]) - F.length(x["value"])), F.lit(mask))).otherwise(x["hit"])
    parts = F.zip_with(F.transform("_found", hidden), F.expr("slice(_gaps, 2, size(_found))"), lambda hit, gap: F.concat(hit, gap))
    d = d.withColumn("_new", F.concat(F.col("_gaps")[0], F.array_join(parts, "")))
    out = []
    for i, (n, c) in enumerate(zip(names, docs.columns)):
        value = F.col(n)
        if i == at:
            value = F.coalesce("_new", n)
        elif c == length:
            value = F.when(F.col("_new").isNotNull() & (F.col("_new") != F.col(names[at])), F.length("_new")).otherwise(value).cast(docs.schema[i].dataType)
        out.append(value.alias(c))
    return d.select(*out)
