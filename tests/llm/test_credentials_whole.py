"""Nothing that is found may survive masking, whatever kind, length, owners or neighbours it has."""

import random
import string

import pytest

from siltstone.llm.credentials import HINT, candidates, find_credentials, mask_credentials, placed, scan_line

LINES = {
    "pw = 'K7$x2q'": ["K7$x2q"], "pw_main='Zq8!kf'": ["Zq8!kf"], "# mysql -h h.example -uapp -pS3cretQx9": ["S3cretQx9"], "sshpass -p 'r7Kq!aTz' ssh h": ["r7Kq!aTz"], "docker login -u a -p qW8!kLp3 r.example": ["qW8!kLp3"],
    "az login --password=Tt7!mmQ2 x": ["Tt7!mmQ2"], "redis-cli -h h -a hR6!kqPw2 ping": ["hR6!kqPw2"], "wget --http-password=uY5!opLk h": ["uY5!opLk"], "// curl -u bot:rPKMvUoRy6xwSmg https://h.example/": ["rPKMvUoRy6xwSmg"],
    'x = "AKIA" "Q7ZP3M9K2L5N8R4T"': ["Q7ZP3M9K2L5N8R4T"], 't = "npm_RD1sBSbioCwklRV0" + "lM9ItqxO42f00BRMbTTl"': ["RD1sBSbioCwklRV0", "lM9ItqxO42f00BRMbTTl"], "passphrase = 'walnut copper ferry pebble'": ["copper ferry"],
    "password = 'two W8rds! here1'": ["W8rds!"], "set_credentials('bot', 'Onyx-walnut6135!')": ["Onyx-walnut6135!"], "client.login(user='a', password=\"c0m3t!8183Q\")": ["c0m3t!8183Q"], "auth_token = '%WLDmqpWQvs9bIH7zie'": ["WLDmqpWQvs9bIH7zie"],
    "secret = '" + "aB3$" * 1200 + "'": ["aB3$aB3$"], "/* old pw was %dX!8hXf+hVT, rotate soon */": ["dX!8hXf"],
}


def test_found_and_masked(spark):
    lines = list(LINES)
    t = spark.createDataFrame([(i, f"a = 1\r\n{line}\r\nb = 2") for i, line in enumerate(lines)] + [(99, "plain text\n")], "file_id long, text string")
    assert {tuple(r) for r in find_credentials(t).select("file_id", "line").distinct().collect()} == {(i, 2) for i in range(len(lines))}
    m = {r["file_id"]: r["masked"] for r in mask_credentials(t).collect()}
    assert m[99] == "plain text\n"
    for i, line in enumerate(lines):
        assert m[i].startswith("a = 1\r\n") and m[i].endswith("\r\nb = 2") and len(m[i]) == len(line) + 14
        for secret in LINES[line]:
            assert secret not in m[i]


@pytest.mark.parametrize("line", ["get_credentials('prod', 'db-main')", "login(user, password)", "password = 'Enter your new password'", "passphrase_hint(x)", "validate_password('abc', 'X9!kkq21')", "token = 'your_token'", "api_key = 'my-api-key'", "secret = '{db_secret}'"])
def test_not_found(line):
    assert candidates(line) == []


def test_owners(spark):
    """A value that nobody makes up stays a secret in any number of files; one of words is a placeholder where most files have it."""
    many = [(i, "key = 1\ndb_pass = 'xQ9!mZt4_Lw7Rb'\n") for i in range(30)] + [(100 + i, "db_pass = 'Shared-77-Value'\n") for i in range(30)]
    few = [(200 + i, "db_pass = 'Harbor-12-Gate'\n") for i in range(3)]
    got = {r["file_id"] for r in find_credentials(spark.createDataFrame(many + few, "file_id long, text string")).collect()}
    assert got == set(range(30)) | {200, 201, 202}
    # owners are counted wherever the literal stands, not only beside a telling name
    plain = [(300 + i, "colour('Harbor-12-Gate')\n") for i in range(20)]
    got = {r["file_id"] for r in find_credentials(spark.createDataFrame(few + plain, "file_id long, text string")).collect()}
    assert got == set()


def test_hints_lose_nothing():
    rng = random.Random(3)
    chars = string.ascii_letters + string.digits + "!$%-_"
    value = lambda: "".join(rng.choice(chars) for _ in range(rng.randrange(6, 24))) + "7aQ!"
    shapes = [
        "{n}={q}{v}{q}", "{n}: {q}{v}{q}", "{n} => {q}{v}{q}", "export {n}={v}", "{n} = {q}{v}{q} + {q}{v}{q}", "{n} = {q}{v}{q} {q}{v}{q}", "authorization: bearer {v}", "x-vault-token: {v}", "amqp://u:{v}@h.example", "curl -u a:{v} h",
        "mysqldump -u a -p{v}", "sshpass -p {v} x", "podman x --password {v}", "helm x -p {v}", "az x -p {v}", "redis-cli -a {v}", "wget --password={v}", "Server=h;Pwd={v};", "account=a; sharedaccesskey={v}", "# {r} was {v}", "log_in({q}a{q}, {q}{v}{q})", "signIn({q}{v}{q})",
    ]
    names = "pw pw_1 PW pwd passwd userPassword kenwort Kennwort mot_de_passe contraseña contrasena clave senha wachtwoord parola hasło haslo secret credentials access_key api-key apikey signingKey masterkey csrf_token auth x_auth accountKeys".split()
    remarks = ["password", "pass", "pw", "login key", "access key", "api key", "token", "secret", "kennwort", "passwort", "mot de passe", "contraseña", "clave", "credential"]
    issued = ["AKIA", "ghp_", "github_pat_", "glpat-", "xoxb-", "sk_live_", "npm_", "pypi-", "eyJ", "AIza", "SG.", "ya29.", "hf_", "dop_v1_", "sk-"]
    seen = 0
    for _ in range(20_000):
        line = rng.choice(shapes).format(n=rng.choice(names), q=rng.choice("\"'"), v=value(), r=rng.choice(remarks))
        if rng.random() < 0.2:
            p = rng.choice(issued)
            body = "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16 if p == "AKIA" else 60 if p == "dop_v1_" else 36))
            cut = rng.randrange(1, len(p) + 5)
            line = rng.choice([f"x = '{p}{body}'", f"x = '{(p + body)[:cut]}' + '{(p + body)[cut:]}'", f'x = "{(p + body)[:cut]}" "{(p + body)[cut:]}"', f"x('{(p + body)[:cut]}''{(p + body)[cut:]}')"])
        whole = placed(line, hints=False)
        seen += bool(whole)
        assert placed(line) == whole, line
        assert HINT.search(line) or not scan_line(line), line
    assert seen > 10_000


def test_nothing_found_survives(spark, data):
    """On the project's own texts: as many characters and lines as before, stars in place of what was found, all else as it was."""
    texts = spark.read.parquet(f"{data}/file_texts.parquet")
    places: dict = {}
    for r in find_credentials(texts).where("start is not null").collect():
        places.setdefault(r["file_id"], []).append((r["start"], r["stop"]))
    assert places
    for r in mask_credentials(texts).where("text is not null").collect():
        a, b = r["text"], r["masked"]
        assert len(a) == len(b) and all(y == x or y == "*" for x, y in zip(a, b))
        stars = {i for i, (x, y) in enumerate(zip(a, b)) if x != y}
        want = {i for s, e in places.get(r["file_id"], []) for i in range(s, e) if a[i] != "*"}
        assert want <= stars
        if "PRIVATE KEY" not in a:
            assert want == stars
