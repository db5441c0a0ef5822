"""License and secret rules beyond the lengths that they once were cut at, and the time they take."""

import random
import re
import string
import time
import uuid

import pytest

from shopfloor.llm import licenses, secret_scan
from tests.llm.tables import documents, read

MEGABYTE = 1_000_000


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train_forest(secret_scan.labelled_findings(spark))


def example(body: str) -> str:
    """A text that a notice pattern matches."""
    body = body.replace("(?:(?!neither).)*?", "Some Holder, Inc.").replace(r"(?:(?!unauthorized|\.\s).)*?", "of this file ")
    body = re.sub(r"\(\?:[^()]*\)\?", "", body)
    body = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", body)
    return re.sub(r"\[(.)[^\]]*\]", r"\1", body).replace(" ?", " ")


@pytest.mark.parametrize("between", [" ", "\n        //  ", "\n" + " " * 14 + "* ", ",\r\n" + "#" + "\t" * 30, " \n *\n * "])
def test_notices_in_comments(scanner, between):
    for label, body in licenses.NOTICES.items():
        words = re.sub(r"[.,]", "", example(body)).lower().split()
        found = scanner.rules(f"x {between.join(words)} y".encode())
        assert label in {d.label for d in found}, label


def test_long_gaps_within_notices(scanner):
    holder = "a company with a very long name and many owners " * 9
    low = f"neither the name of {holder} nor the names of its contributors may be used to endorse".encode()
    assert {d.label for d in scanner.rules(low)} == {"bsd-3"}
    medium = "by any person, in any medium, at any time or place " * 4
    assert {d.label for d in scanner.rules(f"unauthorized copying {medium} is strictly prohibited".encode())} == {"proprietary"}
    assert not scanner.rules(b"unauthorized copying ends. another sentence: smoking is strictly prohibited")


def test_the_keyword_gate_loses_nothing(scanner):
    rng = random.Random(1)
    bodies = [example(b) for b in licenses.NOTICES.values()] + list(licenses.SPDX.values()) + [example(b.split("|")[0]) for b in licenses.NAMES.values()]
    for _ in range(40):
        low = "\n".join(rng.choice(bodies) for _ in range(12)).lower().encode()
        every = {
            (m.start(), m.end(), r.label, r.kind) for r in scanner._rules for m in r.pattern.finditer(low)
        }
        assert {(d.start, d.end, d.label, d.kind) for d in scanner.rules(low)} == every


@pytest.mark.parametrize("unit", ["neither the name of ", "unauthorized use ", "mit ", "license ", " \n* ", "unauthorized copying of x "])
def test_license_rules_take_linear_time(scanner, unit):
    start = time.perf_counter()
    scanner.rules((unit * (MEGABYTE // len(unit))).encode())
    assert time.perf_counter() - start < 6


UNITS = [
    "eyJ-", "eyJaaaaaaaaaaaaa.", "a://b:", "a://b:c@", "a-", "a.b-c_", "password", "password ", "token=", "auth ", "x", "xoxb-",
    "sk_live_", "AB: \n", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY----- x ", "\n ",
]


@pytest.mark.parametrize("unit", UNITS)
def test_secret_patterns_take_linear_time(unit):
    text = unit * (MEGABYTE // len(unit))
    for name, _, pattern in secret_scan.RULES:
        compiled, start = re.compile(pattern), time.perf_counter()
        for _ in compiled.finditer(text):
            pass
        assert time.perf_counter() - start < 2, name


def value(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


ALNUM = string.ascii_letters + string.digits


def test_secrets_behind_long_names_and_in_odd_places(forest):
    rng = random.Random(4)
    key = value(rng, ALNUM, 32)
    finder = secret_scan.Finder(forest, 0.5)

    def found(text):
        return [text[a:b] for a, b, *_ in finder.secrets(text, "")]

    assert found(f"production_environment_database_password = '{key}' end") == [key]
    assert found(f"the.very.long.name.of.a.client-{'x' * 60}-secret{' ' * 30}={' ' * 30}\"{key}\" end") == [key]
    assert found(f"db://admin:{key[:9]}/{key[9:14]}:{key[14:20]}@{key[20:]}@host/path") == [f"{key[:9]}/{key[9:14]}:{key[14:20]}@{key[20:]}"]
    assert found(f"averyveryverylongscheme+tls://admin:{key}@host") == [key]
    assert found("see http://host:8080/path and a@b.example, http://host:443/x@y") == []
    body = "\n".join(value(rng, ALNUM, 64) for _ in range(12))
    closed = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{key.upper()}\n\n{body}\nab12=\n-----END RSA PRIVATE KEY-----"
    assert found(f"x {closed} and prose") == [closed]
    open_end = f"-----BEGIN EC PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\nab12=="
    assert found(f"x {open_end}\nand prose that goes on") == [open_end]
    first, second = closed.replace("END", "ENDE"), closed
    assert found(f"{second}\nprose\n{second}") == [second, second] and len(found(f"{first}\n{second}")) == 2


def planted(rng: random.Random) -> list[tuple[str, bool]]:
    """Texts, each with a secret or with what looks like one; other forms and words than those of the training sample."""
    hexes, upper = "0123456789abcdef", string.ascii_uppercase + string.digits
    secrets = [
        lambda: f"[default]\naws_access_key_id = AKIA{value(rng, upper, 16)}\nregion = eu-west-1",
        lambda: f"aws_secret_access_key={value(rng, ALNUM + '/+', 40)}",
        lambda: f"curl -H 'Authorization: token ghp_{value(rng, ALNUM, 36)}' https://host.example/repos",
        lambda: f"STRIPE={'sk_live_' + value(rng, ALNUM, 24)}",
        lambda: f"SLACK_BOT_TOKEN: xoxb-{value(rng, string.digits, 11)}-{value(rng, ALNUM, 24)}",
        lambda: f"postgres://service:{value(rng, ALNUM + '!#%', 18)}@db.internal:5432/app",
        lambda: f"cookie jwt eyJ{value(rng, ALNUM, 24)}.{value(rng, ALNUM + '-_', 80)}.{value(rng, ALNUM + '-_', 43)} sent",
        lambda: f'{{"client_secret": "{value(rng, ALNUM, 40)}", "id": 7}}',
        lambda: f"export MAILER_PASSWORD='{value(rng, ALNUM + '@!%', 16)}'",
        lambda: f"api-key: {value(rng, hexes, 32)}",
    ]
    harmless = [
        lambda: f"merged commit {value(rng, hexes, 40)} into main",
        lambda: f"sha256:{value(rng, hexes, 64)} layer pulled, digest checked",
        lambda: f"request id {uuid.UUID(int=rng.getrandbits(128))} was served",
        lambda: "password: your-password-here-please",
        lambda: 'token = "<insert your token here>"',
        lambda: f"secret: {'x' * rng.randint(8, 40)}",
        lambda: "the module shopfloor/operators/evidence_rows_of_assemblies holds it",
        lambda: f"isbn 978-3-{value(rng, string.digits, 2)}-{value(rng, string.digits, 6)}-{value(rng, string.digits, 1)} was printed",
        lambda: f"{'=' * rng.randint(24, 70)} a heading {'-' * rng.randint(24, 70)}",
        lambda: f"ETag: \"{value(rng, hexes, 32)}\" revision",
        lambda: "password = get_password_from_environment_variable()",
        lambda: "see https://www.host.example/guide/getting-started/first-steps-with-the-library for more",
    ]
    return [(make(), True) for make in secrets * 30] + [(make(), False) for make in harmless * 30]


def test_planted_secrets_and_look_alikes(spark, forest):
    rows = planted(random.Random(17))
    docs = documents(spark, [(i, f"Some words before. {text}\nAnd some behind it.") for i, (text, _) in enumerate(rows)])
    hit = {r["doc_id"] for r in read(secret_scan.scan_secrets(docs.drop("source"), forest))}
    real = [i for i, (_, secret) in enumerate(rows) if secret]
    caught, wrong = len(hit & set(real)) / len(real), len(hit - set(real)) / (len(rows) - len(real))
    print(f"caught {caught:.3f}, wrong {wrong:.3f}")
    assert caught >= 0.9 and wrong <= 0.1
