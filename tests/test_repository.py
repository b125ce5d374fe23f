"""A repository made in code, queried through the engine; and its storage in packs, bundles and mirrors."""

import os

import pytest
from pyspark.sql import functions as F

from bough.engine import Repository
from bough.functions.decode import encode_tree
from bough.model import EngineError, Limits
from bough.operators import files as R
from bough.operators import refs as refs_
from bough.sources import bundle, manifest, mirror, packs, stores

FILES, TREE, LINK, MODULE = 0o100644, 0o40000, 0o120000, 0o160000


class Maker:
    """Collects the objects of a small repository."""

    def __init__(self):
        self.objects = {}

    def add(self, kind, data):
        oid = packs.object_id(kind, data)
        self.objects[oid] = (kind, data)
        return oid

    def tree(self, entries):
        """entries: name -> bytes, dict, ("link", bytes) or ("module", oid)."""
        rows = []
        for name, x in entries.items():
            raw = name.encode("latin-1")
            if isinstance(x, dict):
                rows.append((TREE, raw, self.tree(x)))
            elif isinstance(x, tuple):
                rows.append((LINK, raw, self.add("blob", x[1])) if x[0] == "link" else (MODULE, raw, x[1]))
            else:
                rows.append((FILES, raw, self.add("blob", x)))
        return self.add("tree", encode_tree(rows))

    def commit(self, tree, parents, time, message=b"m"):
        who = b"A <a@b> %d +0100" % time
        return self.add("commit", b"tree " + tree.hex().encode() + b"\n" + b"".join(b"parent " + p.hex().encode() + b"\n" for p in parents) + b"author " + who + b"\ncommitter " + who + b"\n\n" + message)

    def tag(self, target, kind, name):
        return self.add("tag", b"object " + target.hex().encode() + b"\ntype " + kind.encode() + b"\ntag " + name + b"\ntagger T <t@t> 1 +0000\n\nt")


GUIDE = b"".join(b"guide line %d\n" % i for i in range(20))


@pytest.fixture(scope="module")
def made(spark):
    m = Maker()
    base = {"a-b": b"x", "a.txt": b"one\ntwo Needle\nthree needle needle\n", "a": {"deep": {"z.md": b"needle\n"}, "y.txt": b"yy"}, "copy.txt": b"one\ntwo Needle\nthree needle needle\n", "bin": b"\0needle\n", "ln": ("link", b"needle"), "bad\xff": b"q"}
    c1 = m.commit(m.tree(base), [], 100, b"first\n\nbody")
    second = {**base, "a.txt": b"one\ntwo Needle\nfour\n", "guide": GUIDE}
    c2 = m.commit(m.tree(second), [c1], 200)
    side = {**base, "a.txt": b"zero\none\ntwo Needle\nthree needle needle\n"}
    c3 = m.commit(m.tree(side), [c1], 150)
    gm = b'[submodule "one"]\n path = mods/one\n url = u\n[submodule "two"]\n path = gone\n'
    merged = {**second, "a.txt": b"zero\none\ntwo Needle\nfour\n", ".gitmodules": gm, "mods": {"one": ("module", c1), "bare": ("module", c1)}}
    c4 = m.commit(m.tree(merged), [c2, c3], 300)
    last = {k: v for k, v in merged.items() if k != "guide"}
    last["manual"] = GUIDE.replace(b"guide line 7\n", b"changed\n")
    c5 = m.commit(m.tree(last), [c4], 400)
    t1 = m.tag(c5, "commit", b"v1")
    t2 = m.tag(t1, "tag", b"v2")
    objects = stores.static(spark, list(m.objects.values()), list(m.objects))
    r = spark.createDataFrame(
        [(bytearray(b"HEAD"), "symbolic", None, bytearray(b"refs/heads/main"), None), (bytearray(b"refs/heads/main"), "direct", bytearray(c5), None, None), (bytearray(b"refs/tags/v2"), "direct", bytearray(t2), None, None), (bytearray(b"refs/loop"), "symbolic", None, bytearray(b"refs/loop"), None), (bytearray(b"refs/dangling"), "symbolic", None, bytearray(b"refs/none"), None)],
        "name binary, kind string, oid binary, symbolic_target binary, peeled binary",
    )
    return m, (c1, c2, c3, c4, c5, t2), Repository(spark, objects.cache(), r)


def names(page):
    return [bytes(r["path"]).decode("latin-1") for r in page.items]


def code(f):
    with pytest.raises(EngineError) as e:
        f()
    return e.value.code


def test_snapshots(made):
    _, (c1, _, _, _, c5, t2), repo = made
    assert repo.snapshot("head").commit_oid == repo.snapshot("branch", "main").commit_oid == repo.snapshot("tag", "v2").commit_oid == repo.snapshot("oid", t2.hex()).commit_oid == c5
    assert code(lambda: repo.snapshot("ref", "refs/tags/v2")) == "not_a_commit"
    assert code(lambda: repo.snapshot("revspec", "HEAD~1")) == "unsupported_operation"
    assert code(lambda: repo.resolve("refs/loop")) == "malformed_ref" and code(lambda: repo.resolve("refs/dangling")) == "ref_not_found"
    assert repo.peel(t2, "tree") == repo.snapshot("head").tree_oid and code(lambda: repo.peel(t2, "blob")) == "not_a_blob"
    assert [bytes(r["name"]) for r in repo.list_refs("refs/", limit=2).items] == [b"refs/dangling", b"refs/heads/main"]


def test_listing_order_pages_and_errors(made):
    _, (c1, *_), repo = made
    s = repo.snapshot("oid", c1.hex())
    full = names(s.list_tree(recursive=True))
    assert full == ["a-b", "a.txt", "a", "a/deep", "a/deep/z.md", "a/y.txt", "bad\xff", "bin", "copy.txt", "ln"]
    got, cursor = [], None
    while True:
        page = s.list_tree(recursive=True, limit=3, cursor=cursor)
        got += names(page)
        cursor = page.next_cursor
        if cursor is None:
            break
    assert got == full
    assert names(s.list_tree()) == ["a-b", "a.txt", "a", "bad\xff", "bin", "copy.txt", "ln"]
    assert names(s.list_tree("a", recursive=True, types=("blob",))) == ["a/deep/z.md", "a/y.txt"]
    assert names(s.list_tree(recursive=True, pathspecs=["**/*.md"], types=("blob",))) == ["a/deep/z.md"]
    assert s.list_tree(depth=0).items == [] and [r["size"] for r in s.list_tree(pathspecs=["a-b"], include=("size",)).items] == [1]
    assert code(lambda: s.list_tree("a.txt")) == "not_a_tree" and code(lambda: s.list_tree("no")) == "invalid_path" and code(lambda: s.list_tree("../a")) == "invalid_path"
    page = s.list_tree(recursive=True, limit=3)
    assert code(lambda: s.list_tree(limit=3, cursor=page.next_cursor)) == "invalid_cursor"


def test_read_file(made):
    _, (*_, c5, _), repo = made
    s = repo.snapshot("head")
    whole = s.read_file("a.txt")
    assert bytes(whole["data"]) == b"zero\none\ntwo Needle\nfour\n" and whole["total_lines"] == 4 and whole["kind"] == "text" and not whole["truncated"]
    part = s.read_file("a.txt", lines=(2, 3))
    assert bytes(part["data"]) == b"one\ntwo Needle\n" and (part["start_line"], part["end_line"]) == (2, 3)
    assert bytes(s.read_file("a.txt", max_bytes=12)["data"]) == b"zero\none\n" and s.read_file("a.txt", max_bytes=12)["total_lines"] is None
    assert bytes(s.read_file("a.txt", max_bytes=3)["data"]) == b"zer"
    assert bytes(s.read_file("a.txt", lines=(9, 9))["data"]) == b""
    assert s.read_file("ln")["kind"] == "symlink" and s.read_file("bin")["kind"] == "binary" and s.read_file("mods/one")["kind"] == "gitlink"
    assert s.read_file(b"bad\xff")["total_lines"] == 1 and code(lambda: s.read_file("a")) == "not_a_blob"


def _slices(payload, lines, cap):
    """read_file's slicing, line by line."""
    scanned = payload[:cap]
    rows = scanned.splitlines(keepends=True)
    capped = cap < len(payload)
    partial = bool(rows) and not scanned.endswith(b"\n")
    if lines is None:
        return b"".join(rows[:-1] if capped and partial and len(rows) > 1 else rows)
    out = []
    for i, row in enumerate(rows, 1):
        if lines[0] <= i <= lines[1]:
            if capped and partial and i == len(rows) and out:
                break
            out.append(row)
    return b"".join(out)


def test_slices_against_brute_force(spark):
    payloads = [b"", b"a", b"a\n", b"aa\nbb\ncc", b"aa\nbb\ncc\n", b"\n\n\n", b"long line without end"]
    table = spark.createDataFrame([(bytearray(b"%d" % i), FILES, bytearray(p), bytearray(b"o")) for i, p in enumerate(payloads)], "path binary, mode int, data binary, oid binary")
    for lines in (None, (1, 1), (2, 2), (2, 9), (1, 3)):
        for cap in (1, 3, 4, 7, 100):
            got = {bytes(r["path"]): bytes(r["data"]) for r in R.read(table, lines, cap).collect()}
            assert got == {b"%d" % i: _slices(p, lines, cap) for i, p in enumerate(payloads)}, (lines, cap)


def test_search(made):
    _, (c1, *_), repo = made
    s = repo.snapshot("oid", c1.hex())
    got = [(bytes(r["path"]), r["line"], r["column"], [tuple(x) for x in r["submatches"]]) for r in s.search("needle").items]
    assert got == [(b"a.txt", 3, 6, [(6, 6), (13, 6)]), (b"a/deep/z.md", 1, 0, [(0, 6)]), (b"copy.txt", 3, 6, [(6, 6), (13, 6)])]
    assert [r["line"] for r in s.search("NEEDLE", case_sensitive=False, path="a.txt").items] == [2, 3]
    assert [bytes(r["path"]) for r in s.search("needle", binary="text", pathspecs=["bin"]).items] == [b"bin"]
    r = s.search("e{2}d|T?wo", mode="regex", path="a.txt", context_lines=1).items
    assert [(x["line"], x["column"], [bytes(b) for b in x["context_before"]], [bytes(b) for b in x["context_after"]]) for x in r] == [(2, 1, [b"one"], [b"three needle needle"]), (3, 7, [b"two Needle"], [])]
    page = s.search("needle", limit=2)
    assert page.truncated and [bytes(x["path"]) for x in s.search("needle", limit=2, cursor=page.next_cursor).items] == [b"copy.txt"]
    for bad in (r"(a)\1", "(?=x)", "(?<!x)a", "a++", "(?>x)", "(", "[a", "a{2,1}", "[é]x", "(a|b)*c", "(a+)+b", "(?:x|yy){2,}"):
        assert code(lambda b=bad: s.search(b, mode="regex")) == "unsupported_regex"
    assert [r["line"] for r in s.search("(?P<n>needle) (?:ne+)", mode="regex", path="a.txt").items] == [3]
    assert code(lambda: s.search("x", context_lines=33)) == "invalid_argument"
    assert s.search("needle", limits=Limits(max_object_bytes=5)).warnings
    empty = s.search("", path="a-b").items
    assert [(r["column"], [tuple(x) for x in r["submatches"]], r["submatches_truncated"]) for r in empty] == [(0, [(0, 0)], True)]


def test_search_long_lines(spark):
    line = b"ab" * 3000
    table = spark.createDataFrame([(bytearray(b"p"), FILES, "blob", "o", len(line), bytearray(line))], "path binary, mode int, kind string, oid string, size long, data binary")
    from bough.operators import search

    (r,) = search.search(table, "ab").collect()
    assert r["preview_truncated"] and len(r["preview"]) == 1024 and len(r["submatches"]) == 256 and r["submatches_truncated"]


def test_graph(made):
    _, (c1, c2, c3, c4, c5, _), repo = made
    s = repo.snapshot("head")
    assert [bytes(r["oid"]) for r in s.log().items] == [c5, c4, c2, c3, c1]
    assert [bytes(r["oid"]) for r in s.log(first_parent=True).items] == [c5, c4, c2, c1]
    assert [bytes(r["oid"]) for r in s.log(since=160, until=350).items] == [c4, c2]
    assert [bytes(r["oid"]) for r in s.log(order="topological").items][:2] == [c5, c4]
    assert bytes(s.log(limit=1).items[0]["subject"]) == b"m"
    assert repo.merge_base(c2, c3) == c1 and repo.merge_base(c4, c2, all=True) == [c2]
    assert repo.is_ancestor(c1, c5) and not repo.is_ancestor(c2, c3) and repo.is_ancestor(c3, c3)
    assert code(lambda: repo.is_ancestor(c1, b"1" * 20)) == "not_a_commit"
    assert code(lambda: s.log(order="topological", limits=Limits(max_objects=2))) == "budget_exceeded"
    few, walked, cursor = Limits(max_objects=2), [], None
    while True:
        part = s.log(limits=few, cursor=cursor)
        walked.append([bytes(r["oid"]) for r in part.items])
        if not part.truncated:
            break
        assert part.stats["stopped_by"] == "max_objects"
        cursor = part.next_cursor
    assert walked == [[c5, c4], [c2, c3], [c1]]
    assert code(lambda: repo.read(c1, max_bytes=0)) == "object_too_large" and code(lambda: repo.read(c1, max_bytes=-1)) == "invalid_argument"


def test_history_and_blame(made):
    _, (c1, c2, c3, c4, c5, _), repo = made
    s = repo.snapshot("head")
    assert [(r["path"], bytes(r["commit"])) for r in s.history("a.txt").items] == [("a.txt", c4), ("a.txt", c2), ("a.txt", c3), ("a.txt", c1)]
    assert [(r["path"], bytes(r["commit"]), r["action"]) for r in s.history("manual").items][:2] == [("manual", c5, "added"), ("guide", c2, "added")]
    assert [r["path"] for r in s.history("manual", follow_renames=False).items] == ["manual"]
    assert s.history("never").items == [] and code(lambda: s.history("")) == "invalid_path" and code(lambda: s.history("a.txt", since=1)) == "invalid_argument"
    got = [(r["final_start"], r["final_end"], r["origin_commit"], r["boundary"]) for r in s.blame("a.txt")]
    assert got == [(1, 1, c3.hex(), False), (2, 3, c1.hex(), True), (4, 4, c2.hex(), False)]
    got = [(r["final_start"], r["final_end"], r["origin_commit"], r["origin_path"]) for r in s.blame("manual")]
    assert got == [(1, 7, c2.hex(), "guide"), (8, 8, c5.hex(), "manual"), (9, 20, c2.hex(), "guide")]
    assert code(lambda: s.blame("a.txt", lines=(1, 9))) == "invalid_argument" and code(lambda: s.blame("a")) == "invalid_argument"


def test_diff(made):
    _, (c1, c2, c3, c4, c5, _), repo = made
    at = lambda c: repo.snapshot("oid", c.hex())
    d = at(c4).diff(at(c5), format="stats", renames=True)
    assert [(r["status"], bytes(r["old_path"]), bytes(r["new_path"]), r["additions"], r["deletions"]) for r in d["files"]] == [("renamed", b"guide", b"manual", 1, 1)]
    assert 90 <= d["files"][0]["similarity"] < 100
    d = at(c1).diff(at(c2))
    assert [(r["status"], bytes(r["new_path"]), r["additions"], r["deletions"]) for r in d["files"]] == [("modified", b"a.txt", 1, 1), ("added", b"guide", 20, 0)]
    assert [(r["origin"], bytes(r["content"])) for r in d["lines"]][:4] == [("context", b"one"), ("context", b"two Needle"), ("deletion", b"three needle needle"), ("addition", b"four")]
    assert at(c1).diff(at(c1)) == {"files": [], "lines": [], "truncated": False}
    assert at(c1).diff(at(c2), limits=Limits(max_diff_files=1))["truncated"] and len(at(c1).diff(at(c2), pathspecs=["guide"], format="summary")["files"]) == 1
    assert code(lambda: at(c1).diff(at(c2), copies=True)) == "unsupported_operation"


def test_submodules(made):
    _, (c1, *_), repo = made
    got = [(bytes(r["path"]), r["name"] and bytes(r["name"]), r["status"]) for r in repo.snapshot("head").submodules()]
    assert got == [(b"gone", b"two", "orphaned"), (b"mods/bare", None, "undeclared"), (b"mods/one", b"one", "active")]


def test_objects(made, spark):
    m, (c1, *_), repo = made
    assert repo.header(c1)[0] == "commit" and repo.read(c1)[1] == m.objects[c1][1] and code(lambda: repo.read(c1, max_bytes=3)) == "object_too_large"
    got = repo.read_many([c1, b"9" * 20])
    assert got[c1][0] == "commit" and got[b"9" * 20] is None
    assert code(lambda: repo.read_many([c1], Limits(max_total_object_bytes=2))) == "result_too_large"
    with pytest.raises(EngineError):
        stores.static(spark, [("blob", b"x")], [b"0" * 20])
    assert repo.objects.where(~R.verified(repo.objects)).count() == 0


def test_provider(made, spark):
    class Provider:
        def __init__(self, rows, fault=None):
            self.rows, self.fault = rows, fault

        def read_many(self, ids):
            out = {i: self.rows.get(i) for i in ids}
            if self.fault == "extra":
                out[b"x"] = None
            if self.fault == "damage":
                out = {i: v and (v[0], v[1] + b"!") for i, v in out.items()}
            return out

    m, (c1, c2, *_), _ = made
    ids = spark.createDataFrame([(bytearray(x),) for x in (c1, c2, b"9" * 20, c1)], "oid binary")
    assert {bytes(r["oid"]) for r in stores.provided(ids, Provider(m.objects)).collect()} == {c1, c2}
    for fault, what in (("extra", "provider_protocol_error"), ("damage", "hash_mismatch")):
        with pytest.raises(Exception, match=what):
            stores.provided(ids, Provider(m.objects, fault)).collect()


def test_layers(spark):
    a = spark.createDataFrame([(1, "a", None)], "oid int, data string, error string")
    b = spark.createDataFrame([(1, "b", None), (2, "b", None)], "oid int, data string, error string")
    assert sorted(map(tuple, R.layered([a, b]).collect())) == [(1, "a", 0), (2, "b", 1)]
    with pytest.raises(Exception, match="layer 1"):
        R.layered([a, b.withColumn("error", F.lit("down"))]).collect()


def _table(df):
    return {bytes(r["oid"]): (r["kind"], bytes(r["data"])) for r in df.collect()}


def test_storage(made, spark, tmp_path):
    m, (*_, c5, t2), repo = made
    root = str(tmp_path / "repo.git")
    mirror.init_bare(root)
    assert code(lambda: mirror.init_bare(root)) == "conflict"
    folder = os.path.join(root, "objects", "pack")
    rows = packs.publish_packs(repo.objects, folder, packs=2).collect()
    assert sum(r["pack_size"] for r in rows) == sum(os.path.getsize(os.path.join(folder, r["pack_key"])) for r in rows)
    extra = packs.write_loose(os.path.join(root, "objects"), "blob", b"loose")
    with open(os.path.join(root, "packed-refs"), "wb") as f:
        f.write(b"# pack-refs with: peeled\n" + t2.hex().encode() + b" refs/tags/v2\n^" + c5.hex().encode() + b"\n" + c5.hex().encode() + b" refs/heads/main\n")
    on_disk = Repository.open(spark, root)
    assert _table(on_disk.objects) == {**m.objects, extra: ("blob", b"loose")}
    assert on_disk.snapshot("head").commit_oid == c5
    assert {bytes(r["name"]): r["peeled"] and bytes(r["peeled"]) for r in on_disk.refs.collect()} == {b"HEAD": None, b"refs/heads/main": None, b"refs/tags/v2": c5}

    # hydration: only what is missing
    away = str(tmp_path / "away")
    man = spark.createDataFrame(rows)

    def read_range(key, offset, length, folder=folder):
        with open(os.path.join(folder, key), "rb") as f:
            f.seek(offset)
            return f.read(length)

    assert {r["status"] for r in packs.hydrate(man, read_range, away, window=64).collect()} == {"fetched"}
    assert {r["status"] for r in packs.hydrate(man, read_range, away).collect()} == {"present"}
    with pytest.raises(Exception, match="provider_protocol_error"):
        packs.hydrate(man, lambda k, o, n: b"", str(tmp_path / "x")).collect()
    with pytest.raises(Exception, match="pack_checksum_mismatch"):
        packs.hydrate(man, lambda k, o, n: b"z" * n, str(tmp_path / "y")).collect()
    assert manifest.windows(man, 64).agg(F.sum("length")).first()[0] == sum(r["pack_size"] + r["index_size"] for r in rows)

    # bundle
    path = str(tmp_path / "b" / "one.bundle")
    refs = [(b"refs/heads/main", c5, "commit", None), (b"refs/tags/v2", t2, "tag", c5)]
    b = bundle.write(path, folder, refs, {"source_identity": "test"})
    assert b.generation == 1 and _table(b.objects(spark)) == m.objects and all(r["ok"] for r in bundle.verify(spark, path).collect())
    assert bundle.write(path, folder, refs, {"source_identity": "test"}).generation == 2
    assert code(lambda: bundle.write(path, folder, refs, {"source_identity": "test"}, generation=2)) == "conflict"
    assert bundle.info(path)["refs"] == 2 and b.refs_table(spark).count() == 2
    raw = open(path, "rb").read()
    for name, damaged, want in (("magic", b"X" + raw[1:], "invalid_argument"), ("tail", raw + b"x", "malformed_bundle"), ("toc", raw[:-80] + bytes([raw[-80] ^ 1]) + raw[-79:], "malformed_bundle"), ("version", raw[:8] + b"\2" + raw[9:], "unsupported_operation"), ("short", raw[:40], "malformed_bundle")):
        other = str(tmp_path / name)
        open(other, "wb").write(damaged)
        assert code(lambda o=other: bundle.open_bundle(o)) == want, name
    section = str(tmp_path / "section")
    open(section, "wb").write(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:])
    assert not all(r["ok"] for r in bundle.verify(spark, section).collect())

    # mirror
    store = mirror.LocalStore(str(tmp_path / "store"))
    meta = {"source_identity": "test", "head_symref": "refs/heads/main"}
    assert mirror.publish(store, "k", folder, refs, meta) == ("published", 1) and mirror.publish(store, "k", folder, refs, meta) == ("not_newer", 1)
    assert mirror.publish(store, "k", folder, refs[:1], meta) == ("published", 2)
    assert code(lambda: store.put("k", path, {}, None)) == "conflict" and code(lambda: store.put("k", path, {}, "other")) == "conflict"
    back = mirror.restore(store, "k", str(tmp_path / "restored"))
    assert back.generation == 2 and _table(back.objects(spark)) == m.objects and code(lambda: mirror.restore(store, "k", str(tmp_path / "restored"))) == "conflict"
    text = [(n.decode(), t.hex()) for n, t, *_ in refs]
    assert refs_.tips_digest(spark.createDataFrame(text, "name string, oid string"), "refs/heads/main").first()[0] == mirror.tips_digest(refs, "refs/heads/main")


def test_deltas():
    import hashlib
    import struct
    import zlib

    base = b"hello world, this is the base object"
    delta = bytes([len(base), 16]) + bytes([0b10010000 | 0b1, 0, 11])[:0] + bytes([0x91, 0, 12]) + bytes([4]) + b"text"
    body = bytes([3 << 4 | len(base) & 15 | 128, len(base) >> 4]) + zlib.compress(base)
    oid = packs.object_id("blob", base)
    ofs = bytes([6 << 4 | len(delta) & 15]) + bytes([len(body)]) + zlib.compress(delta)
    ref = bytes([7 << 4 | len(delta) & 15]) + oid + zlib.compress(delta)
    raw = struct.pack(">4sII", b"PACK", 2, 3) + body + ofs + ref
    raw += hashlib.sha1(raw).digest()
    assert [d for _, _, d in packs.read_pack(raw)] == [base, base[:12] + b"text", base[:12] + b"text"]
    with pytest.raises(EngineError, match="pack_checksum"):
        list(packs.read_pack(raw[:-1] + b"\0"))


def test_inventory(spark):
    n = "pack-" + "a" * 40 + ".pack"
    got = manifest.inventory(spark.createDataFrame([("y/" + n, 2), ("x/" + n, 1), ("x/other", 3)], "path string, size long")).collect()
    assert [tuple(r) for r in got] == [(n, "x/" + n, 1)]


def test_refs_rules(spark):
    t = lambda rows: spark.createDataFrame(rows, "name string, kind string, oid long, symbolic_target string")
    refs_.check_write(t([("refs/heads/a", "direct", 1, None)]))
    for rows in ([("refs/heads/a", "direct", 1, None)] * 2, [("refs/heads/a", "direct", 1, None), ("refs/heads/a/b", "direct", 1, None)], [("refs/a b", "direct", 1, None)]):
        assert code(lambda r=rows: refs_.check_write(t(r))) == "malformed_ref"
    chain = t([(f"refs/{i}", "symbolic", None, f"refs/{i + 1}") for i in range(20)] + [("refs/20", "direct", 7, None)])
    got = {r["name"]: (r["status"], r["hops"]) for r in refs_.resolve(chain).collect()}
    assert got["refs/4"] == ("resolved", 16) and got["refs/3"][0] == "too_deep"
    assert code(lambda: refs_.map_refspec("refs/heads/*")) == "invalid_argument"
    over = refs_.overlay(t([("refs/a", "direct", 1, None)]), t([("refs/a", "direct", 2, None), ("refs/b", "direct", 3, None)]))
    assert sorted((r["name"], r["oid"]) for r in over.collect()) == [("refs/a", 1), ("refs/b", 3)]
