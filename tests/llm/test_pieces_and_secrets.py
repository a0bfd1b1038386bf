import hashlib
import random

import pytest

from shelfmark.llm.pieces import PieceEncoder, model_path, piece_codes
from shelfmark.llm.secrets import lexed_spans, op4_secret_scan, scan, secret_spans

HARD = ["", " ", "  a b", "\n\n a\tb", "a  b ", "\xa0x", "▁x", "x▁▁y ▁ z", "😀a<s></s><unk>", "ﬁ", "\x00a", "<0x41>", "a" * 500, "ab" * 3000, " " * 37 + "x", "梦梦 梦"]


def test_ids_equal_the_library():
    coder = PieceEncoder(model_path())
    r = random.Random(1)
    letters = "ab e\n▁tio<>0x4é梦😀́ '"
    texts = HARD + ["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(1500)]
    for text, (joined, ids) in zip(texts, coder.encode_batch(texts), strict=True):
        assert ids.tolist() == coder.sp.encode(text), text
        assert joined.decode() == ",".join(map(str, ids.tolist()))


def test_heap_and_side_by_side_agree():
    coder = PieceEncoder(model_path(), verify=False)
    for s in ("▁international", "▁Größe", "▁x梦y"):
        assert coder._heap(s) == coder._together([s])[0] == coder.sp.encode(s[1:])


def test_cache_turns_over(monkeypatch):
    import shelfmark.llm.pieces as P

    for most in (3, 8, 9, 12):
        monkeypatch.setattr(P, "MEMORY_SEGMENTS", most)
        coder = PieceEncoder(model_path())
        for texts in (["one two three four five", "", "six seven one two"], ["eight nine ten one", "two, three"], ["one"]) * 3:
            assert [ids.tolist() for _, ids in coder.encode_batch(texts)] == coder.sp.encode(texts)


def test_a_wrong_merge_is_noticed():
    coder = PieceEncoder(model_path())
    coder.rank[:-1] = coder.rank[:-1][::-1].copy()
    coder.merges = {}
    for text in ("international understanding", "fine  international", "x\ninternational"):
        with pytest.raises(ValueError, match="library"):
            list(coder.encode_batch(["", "a ", text]))
    # A wrong segment inside a text is noticed wherever it stands, a lone mark at the end too.
    for text in ("ab cd", "ab ", "ab\ncd", "  ab"):
        coder = PieceEncoder(model_path())
        learn = coder._learn
        for k in range(len(coder._segments([text])[1])):
            coder.memory.__init__()
            coder._learn = lambda new, k=k: [[5] if j == k else ids for j, ids in enumerate(learn(new))]
            with pytest.raises(ValueError, match="library"):
                list(coder.encode_batch([text]))


def test_codes_of_awkward_rows(docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rows = piece_codes(docs, keep_ids=True).collect()
    text_of = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            ids = sp.encode(text_of[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_codes(no_docs).count() == 0


def test_base_patterns():
    text = 'password = "abcdef" PASSWD:abc token: secret=zzzzzz AKIA' + "A" * 16 + " " + "0a" * 12 + " API_KEY='k-=/+._1'"
    found = scan(text)
    assert [text[a:b] for a, b in found["assign"]] == ['password = "abcdef', "token: secret=zzzzzz", "API_KEY='k-=/+._1"]
    assert [text[a:b] for a, b in found["access"]] == ["AKIA" + "A" * 16]
    assert [text[a:b] for a, b in found["hex"]] == ["0a" * 12]
    assert scan("ſecret=abcdefgh")["assign"] == []  # letters in either case are A-Z only


def test_failing_match_still_consumes():
    assert scan("token=abc=x")["assign"] == [] and scan("token=abc=xy")["assign"] == [(0, 12)]
    assert scan("password: token: abcdefgh")["assign"] == []


def test_lexer_propagates_constants():
    text = 'DEFAULT = "hX9!kk22Lq"\nuser = "plainname"\npassword = DEFAULT\n'
    assert [text[a:b] for a, b in lexed_spans(text)] == ["hX9!kk22Lq"]
    assert lexed_spans('title = "hX9!kk22Lq"') == []
    assert lexed_spans('password = "${FROM_ENV}"') == []


def test_secrets_of_awkward_rows(docs, no_docs):
    rows = {r.doc_id: r for r in secret_spans(docs).collect()}
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].spans == ""
    assert rows[6].n_assign == 1 and rows[6].spans.startswith("assign:")
    assert secret_spans(docs).count() == docs.count() and secret_spans(no_docs).count() == 0


FORMS = [
    'cfg["secret_key"] = "{}"', 'os.environ["DB_PASSWORD"] = "{}"', "<password>{}</password>", '#define API_SECRET "{}"', 'password = """{}"""', "password: >\n  {}\nnext: 1",
    'connect(host="x", password="{}")', '{{"password": "{}", "x": 1}}', "export API_TOKEN={}", "password={}", "password: {}", "client_secret => '{}'", 'db_password: str = "{}"',
    'const clientSecret: string = "{}";', 'a = password = "{}"', 'password = a = "{}"', 'val apiToken: String? = "{}"', 'let secret: &str = "{}";', 'password: Optional[str]="{}"',
    'x = "{}"\npassword = x', 'os.environ.setdefault("DB_PASSWORD", "{}")', 'password := "{}"', 'self.password = r"{}"', "--password={} --x", "settings.API_TOKEN = ('{}')",
    "password = '''\n{}\n'''", "const t = `{}`; token = t;", 'a = "{}"; b = a; password = b',
]
HARMLESS = [
    'sort_key = "created"', "the password is: see below", "token: the next one", 'api = "v1"', 'password = os.environ["X"]', "password = getpass()", "secret = None", 'password: "${DB_PASS}"',
    "key: value", "access = public", 'author = "Jane Doe"', 'x = "hT7-kQ9z_Lm42xB"; x = "hello world"; password = x', "pass the salt: please", 'keyword = "aB3xK9qLmZ27"', "def token(x): return x",
]


def test_secrets_planted_in_every_form():
    r = random.Random(3)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    caught = 0
    for form in FORMS:
        for _ in range(5):
            secret = "".join(r.choice(letters) for _ in range(10)) + "-_7qX" + "".join(r.choice(letters) for _ in range(6))
            text = f"some words before it\n{form.format(secret)}\nand after: it = nothing"
            caught += [text[a:b] for a, b in lexed_spans(text)] == [secret]
    assert caught >= 0.95 * 5 * len(FORMS)
    assert sum(bool(lexed_spans(t)) for t in HARMLESS) == 0


def test_joined_strings_are_one_literal():
    for text in ('password = "hT7-kQ9z" + "_Lm42xB9q"', "password = ('hT7-kQ9z'\n  '_Lm42xB9q')", 'password = "hT7-kQ9z" \\\n "_Lm42xB9q"'):
        (a, b), = lexed_spans(text)
        assert text[a:].startswith("hT7") and text[:b].endswith("xB9q")


def plain_base(text):
    """The contract's three kinds, by hand."""
    import re

    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_the_query_equals_the_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op4_secret_scan(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        want, r = plain_base(row.text or ""), got[row.doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))
