"""Generator of labelled text for the span taggers: invented prose with secrets, personal data and look-alikes."""

from __future__ import annotations

import random
import string

_SYLLABLES = [
    "an er in on the th re and ing ed ha es or ti st en of nt to it is ea ou sh ly tion ble wh at nd was for".split(),
    "der die und ein ich en er sch ch te ge be ver lich heit keit ung zu st au ei ü ä ö ß in mit von pf tz".split(),
    "de la le que les des é è ê ç ou on an en ai oi eau eux tion ment ent re tre pa vi qui une ier aux ch".split(),
    "de la el que los las ción ía ado mente ar er ir ro ra co ca ñ ó í es en un una por para ez bo mi ta".split(),
    "lo tra ma ne ku sa we mo xi ba du fi go ze pro con dis ex mal ben".split(),
]
HEX, ALNUM = "0123456789abcdef", string.ascii_letters + string.digits


def pick(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def digits(rng: random.Random, n: int) -> str:
    return pick(rng, string.digits, n)


def word(rng: random.Random, syllables: list[str] | None = None) -> str:
    s = syllables or rng.choice(_SYLLABLES)
    return "".join(rng.choice(s) for _ in range(rng.choice((1, 1, 2, 2, 3, 4))))


def prose(rng: random.Random, n: int) -> list[str]:
    """n words in one of several styles, junk ones included."""
    s, style, out = rng.choice(_SYLLABLES), rng.random(), []
    for _ in range(n):
        w = word(rng, s)
        r = rng.random()
        if style < 0.1:
            w = w.upper() + "!!"
        elif style < 0.2:
            w += rng.choice(("###", "***", "$$$", "%%%", "&&&"))
        elif style < 0.27:
            w += " |"
        elif style < 0.3:
            w = f"{w}_{word(rng, s)}" if r < 0.5 else w + rng.choice(("();", " =", ":", "{", "}", " ==", "[0]", '"', "'"))
        elif r < 0.08:
            w = w.capitalize()
        elif r < 0.16:
            w += rng.choice((".", ",", ";", ":", "?", "!", ".\n", ")", "\n"))
        elif r < 0.17:
            w = rng.choice((f"({w}", f'"{w}"', f"'{w}'", f"-{w}", f"{w}/{word(rng, s)}", f"{w}-{word(rng, s)}"))
        out.append(w)
    return out


def email(rng: random.Random) -> str:
    name = rng.choice((word(rng, _SYLLABLES[0]), word(rng, _SYLLABLES[4]) + rng.choice("._-") + word(rng, _SYLLABLES[4]), word(rng, _SYLLABLES[0])[:9]))
    name += rng.choice(("", "", f".{digits(rng, 2)}", digits(rng, rng.randint(1, 4)), f"_{digits(rng, 3)}", f"+{word(rng, _SYLLABLES[4])}"))
    host = rng.choice(("mail", "web", "post", word(rng, _SYLLABLES[4]))) + rng.choice(("", str(rng.randint(0, 99))))
    return f"{name}@{host}.{rng.choice(('example.com', 'example.org', 'com', 'net', 'org', 'io', 'co.uk', 'de', 'fr', 'es', 'edu'))}"


def phone(rng: random.Random) -> str:
    a, b, c = digits(rng, 3), digits(rng, 3), digits(rng, 4)
    return rng.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {a} {b}{c}", f"+1 {a} {b} {c}", f"+{rng.randint(30, 59)} {digits(rng, 2)} {b} {c}"))


def ip(rng: random.Random) -> str:
    return ".".join(str(rng.randint(0, 255)) for _ in range(4))


def card(rng: random.Random) -> str:
    a = rng.choice("3456") + digits(rng, 15)
    if rng.random() < 0.15:
        a = digits(rng, 16)
    return rng.choice((a, a, a, " ".join(a[k : k + 4] for k in range(0, 16, 4)), "-".join(a[k : k + 4] for k in range(0, 16, 4))))


PERSONAL = {1: email, 2: phone, 3: ip, 4: card}


def look_alike(rng: random.Random) -> str:
    """What is neither personal data nor a secret, but has digits, signs or capitals."""
    n, d = rng.randint(1, 9999), digits
    return rng.choice(
        (
            lambda: str(rng.randint(0, 10 ** rng.randint(1, 9))), lambda: f"{rng.randint(1900, 2040)}-{d(rng, 2)}-{d(rng, 2)}", lambda: f"{d(rng, 2)}/{d(rng, 2)}/{d(rng, 4)}",
            lambda: f"{d(rng, 2)}:{d(rng, 2)}", lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: f"${n},{d(rng, 3)}.{d(rng, 2)}",
            lambda: f"{n}%", lambda: f"http://{word(rng)}.example.com/{word(rng)}/{n}?page={n}&ref=x", lambda: f"@{word(rng)}", lambda: f"#{n}", lambda: f"{rng.randint(1, 99)}.{d(rng, rng.randint(1, 8))}",
            lambda: f"x{n} = {n};", lambda: f"({n})", lambda: f"+{rng.randint(1, 20)}", lambda: f"{n}-{n}", lambda: f"{word(rng)}{n}", lambda: f"[{n}, {n + 1}, {n * 2}]",
            lambda: f"Section {rng.randint(1, 9)}.{rng.randint(1, 9)}", lambda: f"no. {d(rng, 7)}", lambda: word(rng).upper() + d(rng, 3), lambda: f"Copyright {rng.randint(1990, 2030)}",
        )
    )()


def harmless_key(rng: random.Random) -> str:
    """Identifiers, digests and assignments that are no secret."""
    h = pick(rng, HEX, 32)
    return rng.choice(
        (
            lambda: f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", lambda: f"sha256:{pick(rng, HEX, 64)}", lambda: f"sha1 {pick(rng, HEX, 40)}", lambda: f"commit {pick(rng, HEX, 40)}", lambda: f"md5 = {h}", lambda: f"checksum: {h}", lambda: f"id={digits(rng, 8)}",
            lambda: f'name = "{word(rng)}"', lambda: f'{word(rng)} = "{word(rng)} {word(rng)}"', lambda: f'path = "/{word(rng)}/{word(rng)}"', lambda: f"token {word(rng)}", lambda: f"the password {word(rng)} {word(rng)}", lambda: f"a secret, {word(rng)}", lambda: f"key {word(rng)}", lambda: f"token = {word(rng)}",
            lambda: f"color: #{pick(rng, HEX, 6)}", lambda: f'count = "{digits(rng, 3)}"', lambda: email(rng), lambda: ip(rng), lambda: card(rng), lambda: phone(rng), lambda: f"blob {pick(rng, HEX, 7)}", lambda: f"0x{pick(rng, HEX, 8)}", lambda: f"{word(rng)}_{word(rng)} = {digits(rng, 5)}",
        )
    )()


def secret(rng: random.Random) -> tuple[str, str, str]:
    """Text before, the secret, text after."""
    body = rng.choice((lambda: pick(rng, HEX, rng.choice((32, 40, 40, 40, 48, 64))), lambda: pick(rng, ALNUM, rng.randint(20, 44)), lambda: pick(rng, ALNUM + "+/", 40), lambda: pick(rng, string.ascii_uppercase + string.digits, rng.randint(20, 32)), lambda: pick(rng, ALNUM + "-_", rng.randint(24, 44))))()
    known = rng.choice(
        (
            lambda: rng.choice(("AKIA", "ASIA")) + pick(rng, string.ascii_uppercase + string.digits, 16), lambda: rng.choice(("ghp_", "gho_", "ghs_")) + pick(rng, ALNUM, 36), lambda: rng.choice(("sk_live_", "sk_test_", "pk_live_", "rk_live_")) + pick(rng, ALNUM, 24),
            lambda: "sk-" + pick(rng, ALNUM, 48), lambda: f"xox{rng.choice('bpa')}-{digits(rng, 11)}-{digits(rng, 11)}-{pick(rng, ALNUM, 24)}", lambda: "AIza" + pick(rng, ALNUM + "_-", 35), lambda: "glpat-" + pick(rng, ALNUM, 20), lambda: "npm_" + pick(rng, ALNUM, 36),
            lambda: f"eyJ{pick(rng, ALNUM, 33)}.eyJ{pick(rng, ALNUM, 60)}.{pick(rng, ALNUM + '_-', 43)}", lambda: f"hf_{pick(rng, string.ascii_letters, 34)}", lambda: f"{pick(rng, digits(rng, 9) + ALNUM, 24)}.{pick(rng, ALNUM, 6)}.{pick(rng, ALNUM, 27)}",
        )
    )
    key = rng.choice("token api_key apikey api-key secret password passwd pwd access_token auth_token client_secret secret_key private_key aws_secret_access_key AWS_SECRET_ACCESS_KEY API_KEY SECRET_KEY TOKEN DB_PASSWORD credentials".split())
    r = rng.random()
    if r < 0.62:
        key = "token" if rng.random() < 0.4 else key
        q = rng.choice(('"', '"', "'", ""))
        return f"{key}{rng.choice((' = ', ' = ', '=', ': ', ':', ' := ', ' => '))}{q}", body if rng.random() < 0.8 else known(), q + rng.choice(("", "", "", ";", ",", "\n", "###", "!!", "."))
    if r < 0.67:
        return rng.choice(("Authorization: Bearer ", "Bearer ", "authorization: token ", "--token ", "-H 'X-Api-Key: ")), body, rng.choice(("", "'", "\n"))
    if r < 0.72:
        return f"{rng.choice(('postgres', 'mysql', 'https', 'mongodb'))}://{word(rng, _SYLLABLES[4])}:", pick(rng, ALNUM, rng.randint(10, 20)), f"@{word(rng, _SYLLABLES[4])}.example.com/{word(rng, _SYLLABLES[4])}"
    if r < 0.77:
        kind = rng.choice(("RSA ", "EC ", "OPENSSH ", ""))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n", "\n".join(pick(rng, ALNUM + "+/", 64) for _ in range(rng.randint(1, 4))), f"\n-----END {kind}PRIVATE KEY-----"
    if r < 0.85:
        p = rng.choice("!@#$%-_") + digits(rng, rng.randint(2, 4))
        return f"{rng.choice(('password', 'passwd', 'PASSWORD', 'db_password'))}{rng.choice((' = ', '=', ': '))}{(q := rng.choice(('\"', '')))}", word(rng, _SYLLABLES[4]).capitalize() + word(rng, _SYLLABLES[4]) + p, q
    return rng.choice(("", "", "key: ", "use ", "(")), known(), rng.choice(("", "", ".", ",", ")", "###", "!!"))


def compose(rng: random.Random, length: int, items: list[tuple[int, str, str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """Prose of about ``length`` words with (label, before, span, after) items strewn in; the labelled spans."""
    parts = [(0, "", w, "") for w in prose(rng, length)]
    for item in items:
        parts.insert(rng.randint(0, len(parts)), item)
    text, spans = "", []
    for label, before, span, after in parts:
        text += before
        if label:
            spans.append((len(text), len(text) + len(span), label))
        text += span + after + (rng.choice((" ", " ", " ", "\n")) if rng.random() < 0.2 else " ")
    return text, spans
