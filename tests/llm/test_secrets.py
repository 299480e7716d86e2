import hashlib
import random
import re
import zlib

from evidentia.llm import secrets as S

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out, key=lambda s: (s[0], S.KINDS.index(s[2])))


def github(body):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, r = divmod(value, 62)
        digits = S._B62[r] + digits
    return "ghp_" + body + digits.rjust(6, "0")


def texts():
    rng = random.Random(5)
    parts = ["token=", "Token : '", "password", 'secret"= ', "api_key:", "APIKEY=", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "é", " ", "\n", "=", "ſecret=", "日本", "A1b2C3d4E5f6", "x-y_z/=+."]
    return ["", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400))]


def test_base_spans_against_plain_patterns(make):
    rows = list(enumerate(texts()))
    got = {r.id: [(x.start, x.end, x.kind) for x in r.spans if x.kind in S.KINDS[: S.BASE]] for r in S.scan_secrets(make(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_checksums_decide():
    good = github("0123456789abcdefghijABCDEFGHIJ")
    assert any(k == "github" for _, _, k in S.find_spans(b"x " + good.encode()))
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert not any(k == "github" for _, _, k in S.find_spans(b"x " + bad.encode()))


def test_edges(make, documents, spark):
    rows = make([(1, None), (None, "password=abcdefghijkl"), (2, ""), (2, "")])
    assert sorted((r.id is None, len(r.spans)) for r in S.scan_secrets(rows).collect()) == [(False, 0), (False, 0), (False, 0), (True, 1)]
    assert S.scan_secrets(make([])).count() == 0
    assert [r.text for r in S.redact(make([(1, "é token=abcdefghijklmnop z"), (2, None)])).orderBy("doc_id").collect()] == ["é [secret] z", None]
    r = S.op1_secret_scan(spark, documents([(3, "é password=abcdefghijkl")])).first()
    assert (r.n_assign, r.spans, r.base_sha256) == (1, "assign:2:23", hashlib.sha256(b"assign:2:23").hexdigest())
