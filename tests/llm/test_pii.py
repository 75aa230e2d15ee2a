import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from logradex.llm import pii

from .test_llm import ODD, frame, luhn

KEY = "a key"


def shifted(c, amount):
    low = c.lower()
    for cls in pii._CLASSES:
        if low in cls:
            new = cls[(cls.index(low) + amount) % len(cls)]
            return new if c == low else new.upper()
    for a, b in pii._RANGES:
        if a <= ord(c) <= b:
            return chr(a + (ord(c) - a + amount) % (b - a + 1))
    return c


def permuted(v, salt):
    """The permutation by its definition."""
    def keyed(way, part):
        text = "\x1f".join([KEY, salt + way, part.lower(), str(len(v))])
        return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)

    one = "".join(shifted(c, keyed(">", v[:i])) for i, c in enumerate(v))
    return "".join(shifted(c, keyed("<", one[i + 1 :])) for i, c in enumerate(one))


def test_permutation_agrees_with_its_definition(spark):
    rng = random.Random(2)
    letters = "abzABZ019 éçÜß-.іяЯσΩ李あアกא한"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))) for i in range(300)]
    got = frame(spark, rows).select("text", pii.permute(F.col("text"), KEY, F.lit("s")).alias("new")).collect()
    assert all(r.new == permuted(r.text, "s") for r in got)


PEOPLE = [
    "Amira Hassan wrote to Bob Jones", "Dear Zofia Kowalska", "my name is Xander Quill", "Dr. Weatherby", "Frau Müller-Lüdenscheidt",
    "Name: Ludwig van Beethoven", "Мария Иванова", "Кирилл Шевченко", "Ελένη Παπαδοπούλου", "dear Sean O'Brien", "Mary McDonald",
    "Prof. Nkechi Okafor", "Señora García", "Regards,\nJean-Luc Picard", "contact: Yewande Adeyemi",
]


def test_people_beyond_the_list(spark):
    out = pii.with_surrogates(frame(spark, list(enumerate(PEOPLE))), key=KEY).collect()
    kept = {w for p in PEOPLE for w in p.split()} & set("wrote to Dear dear my name is Dr. Frau Name: Prof. Señora Regards, contact: van".split())
    for r in out:
        old, new = PEOPLE[r.doc_id].split(), r.text.split()
        assert len(old) == len(new) and all((a == b) == (a in kept) for a, b in zip(old, new)), r.text
        assert [w[0].isupper() for w in old] == [w[0].isupper() for w in new]
    by_id = {r.doc_id: r.text.split() for r in out}
    assert by_id[6][0] in pii.GIVEN["f", "cyrillic"].split() and by_id[6][1].endswith("ова")
    assert by_id[7][1].endswith("нко") and by_id[8][1].endswith("λου") and by_id[0][0] in pii.GIVEN["f", "latin"].split()


def test_plain_text_is_left_alone(spark):
    plain = [
        "The United States and New York were named. He met with The Times in San Francisco.", "Dear Sir, thank you. Version 10.2.3, page 12-14",
        "Then She said no. In April the Old Town lived on.", "a@b, x@y z, meet@5.30, 1.2.3.4.5, 555-12, AB12 3, GB82", "die Frau sah den Dr. an",
        "Иван пошёл в Новый Город. Привет Мир", "",
    ]
    out = pii.with_surrogates(frame(spark, list(enumerate(plain))), key=KEY).collect()
    assert {r.doc_id: r.text for r in out} == dict(enumerate(plain))


def mod97(v):
    flat = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def test_no_entity_is_left(spark):
    rng = random.Random(6)
    labels = ".".join(f"sub{i}" for i in range(18))
    made = [f"jo.doe@{labels}.example.com", "jörg@müller.de", "李@例子.中国", "a@b.com.", "x+y@1st.co.uk,", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000",
            "+49 30 1234567", "+493012345678", "+1 (949) 555-3553", "1-949-555-3553", "+19495553553", "4111 1111 1111 1111"]
    for _ in range(60):
        made.append(f"{''.join(rng.choice('abc.x_') for _ in range(6))}q@{'.'.join('d' * rng.randint(1, 3) for _ in range(rng.randint(1, 30)))}.org")
    out = pii.with_surrogates(frame(spark, [(i, f"see {m} now") for i, m in enumerate(made)]), key=KEY).collect()
    for r in out:
        old, new = made[r.doc_id], r.text[4:-4]
        assert old.strip(".,") != new.strip(".,") and len(old) == len(new)
        assert old.strip(".,") not in r.text
    new = {made[r.doc_id]: r.text[4:-4] for r in out}
    assert all(mod97(new[k]) == 1 and new[k][:2] == k[:2] for k in made[5:7]) and luhn(new[made[12]])
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(new[made[9]]) == digits(new[made[10]]) == digits(new[made[11]]) and new[made[7]].startswith("+49")


def test_search_agrees_with_another_engine(spark):
    """The same patterns by another matcher."""
    rng = random.Random(4)
    parts = ["jo@x.org", "a.b@c.de.", "@", " ", ", ", "Maria", " Smith", "Dr. ", "Dear ", "Bob", " Jones", " said", "10.0.0.1", "256.1.1.1", "123-45-6789", "+1 (949) 555-3553",
             "4785380592391139", "GB82WEST12345698765432", "x", "é", "Иван", " Петров", "-", "van ", "\n", "0"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(500)]
    pattern = regex.compile(pii.ENTITY)
    got = frame(spark, rows).select("doc_id", pii.entities(F.col("text")).alias("found")).collect()
    for r in got:
        assert list(r.found) == [m[0] for m in pattern.finditer(rows[r.doc_id][1])]


def test_keys_are_checked(spark, monkeypatch):
    df = frame(spark, [(1, "jo@x.org and +1 949 555 3553 and 949-555-3553 and +19495553553, 10.0.0.1, Maria Smith"), (2, None)])
    assert pii.checked_key(df, KEY) == KEY
    assert pii.session_key(spark) == pii.session_key(spark)
    same = df.union(frame(spark, [(3, "ab@x.org")]))
    monkeypatch.setattr(pii, "KEYS_TRIED", 2)
    monkeypatch.setattr(pii, "permute", lambda v, key, salt: F.lit("aa"))
    with pytest.raises(ValueError):
        pii.checked_key(same, KEY)


def test_odd_rows(spark):
    wide = frame(spark, [(i, t, "e", 1) for i, t in ODD], "doc_id long, text string, entities_found string, entity int")
    out = pii.with_surrogates(wide, key=KEY, count_col="n")
    assert out.columns == [*wide.columns, "n"]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(ODD, key=key)
    none = frame(spark, [])
    assert pii.with_surrogates(none, key=KEY).count() == 0 and pii.checked_key(none, KEY) == KEY
