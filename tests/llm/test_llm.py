import random

from pyspark.sql import functions as F

from trajlake.llm import boilerplate, leakage, packing, pages, pairs, pii, splits, subjects, toxicity, truncation

OBS = "obs_id long, identifier string, current_url string, processed_text string, raw_html string"


def test_page_lines():
    text = "[id: 1] Home link [id: 2] News link\n## Related pages\n[id: 3] Old stories of the mill link\n# The mill\nThe mill turns all night.\nShare this page with a friend.\n[id: 4] The mill in 1990 link\n© 1990 Mill. All rights reserved."
    assert pages.body_lines(text, None) == [3, 4, 6]
    assert pages.body_verdict(["Welcome to {{ name }}"]) == "field"
    assert pages.body_verdict(["Write `{{ name }}` in the file and the engine swaps it."]) == "own"
    assert pages.body_verdict(["404", "Page not found"]) == "error"
    assert pages.body_verdict(["A page not found in the atlas was added by the binder in 1950.", "The rest of the atlas is complete and well kept."]) == "own"
    assert pages.body_lines("", None) == []
    assert pages.html_runs("<p>a<p>b")


def test_residue_and_lines_edge_cases(spark):
    rows = [(1, None, None, None, None), (2, "a", "http://a/x", "", None), (3, "a", "http://a/x", "JavaScript is disabled. To see the content, switch it on and reload.", "<p>"), (3, "a", "http://a/x", "JavaScript is disabled. To see the content, switch it on and reload.", "<p>"), (4, "a", "http://a/x", "# T\n" + "The mill turns. " * 20000, None)]
    df = spark.createDataFrame(rows, OBS)
    assert {r.obs_id for r in boilerplate.residue_pages(df).collect()} == {3}
    assert {(r.obs_id, r.line_no) for r in boilerplate.main_lines(df).collect()} == {(4, 0), (4, 1)}
    assert boilerplate.main_lines(df.limit(0)).count() == 0


def test_pairs(spark):
    full = "I cannot find the entry on the mill yet, so I will keep looking."
    rows = [("action", i, 1, "m", f"{full}\n\n```json\n{{\"a\": 1}}\n```") for i in range(10)]
    rows += [("action", 20, 1, "m", None), ("action", 21, 1, "m", "```json\n{}\n```"), ("action", 22, 1, "m", "I'm sorry, but I can't help with that request."), ("action", 23, 1, "m", "You asked: Find the mill and name its owner."),
             ("action", 24, 1, "m", "I cannot find the entry on the mi"), ("action", 25, 1, "m", "Je ne trouve pas encore la bonne entrée, je continue à chercher dans la liste."), ("action", 26, 9, "m", "Find the mill and name its owner."), ("action", 27, None, "m", full)]
    tasks = spark.createDataFrame([(1, "Find the mill and name its owner."), (2, None)], "task_id long, instruction string")
    df = spark.createDataFrame(rows, "src string, row_id long, task_id long, source string, response string")
    got = {r.row_id: r.defect for r in pairs.broken_pairs(df, tasks).collect()}
    assert got == {20: "empty", 21: "empty", 22: "refusal", 23: "copied", 24: "truncated", 25: "wrong_language"}
    assert pairs.broken_pairs(df.limit(0), tasks).count() == 0


def test_neighbours(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in set(words)], "s string")
    want = {a for a in set(words) if any(b != a and b.startswith(a) for b in set(words))}
    assert {r.s for r in pairs.neighbour_prefixes(df, 7).collect()} == want


def test_truncation(spark):
    full = "The list is filtered, and the mill should appear within the first rows."
    rows = [("action", i, "m", f"{full}\n\n```json\n{{\"a\": 1}}\n```") for i in range(10)]
    rows += [("action", 20, "m", "The list is filtered, and the mi"), ("action", 21, "m", full), ("action", 22, None, "Text.\n\n```json\n{\"a\""), ("action", 23, "m", None), ("action", 24, "m", "  "), ("action", 25, "m", "The answer is next to ✅")]
    df = spark.createDataFrame(rows, "src string, row_id long, source string, response string")
    assert {r.row_id for r in truncation.cut_records(df).collect()} == {20, 22}
    assert truncation.cut_records(df.limit(0)).count() == 0


def test_pii_spans_and_round_trip():
    t = "Ask for J. Zimström at the counter. Write to a.b at post dot test or call (231) 555-0104. SSN: 923-70-3950. Parcels should go to Flat 2, 16 Havfield Street, Quorhaven. Part 555-2252-0043 fits. Follow @site."
    got = [(k, t[a:b]) for a, b, k in pii.spans(t)]
    assert got == [("NAME", "J. Zimström"), ("EMAIL", "a.b at post dot test"), ("PHONE", "(231) 555-0104"), ("ID_NUMBER", "923-70-3950"), ("ADDRESS", "Flat 2, 16 Havfield Street, Quorhaven")]
    for a in ("x@post.test", "х@pоst.test", "x​@post.test", "x (at) post (dot) test"):
        s, at = pii.plain_form("to " + a + " now")
        assert "x@post.test" in s
        assert [("to " + a + " now")[i:j] for i, j, k in pii.spans("to " + a + " now") if k == "EMAIL"] == [a]
    assert pii.spans("") == [] and pii.spans("Install larkmoor@2.9.1 and restart on 1965-11-02.") == []
    assert pii.plain_form("call two three one five five five zero one")[0] == "call 231555" + "01"


def test_toxicity_separates():
    good = [f"The mill number {i} turns all night. The owner of the mill likes figure {i}." for i in range(200)]
    bad = [g + f" You are a worthless idi{'o' * (1 + i % 5)}t." for i, g in enumerate(good[:60])]
    m = toxicity.fit(bad[:40], good)
    cut = toxicity.best_threshold([toxicity.score_text(t, m, {}) for t in bad[40:]], [toxicity.score_text(t, m, {}) for t in good])
    assert all(toxicity.score_text(t, m, {}) > cut for t in bad[40:])
    assert sum(toxicity.score_text(t, m, {}) > cut for t in good) <= 2
    assert toxicity.tokens("n u d e, i.d.i.o.t losssser p0rn id***t") == ["nude", "idiot", "loser", "porn", toxicity.MASK]
    assert toxicity.fit([], good) == {"": -1.0}


def test_hosts_and_components(spark):
    df = spark.createDataFrame([(" HTTP://u@WWW.Foo.co.example.:80/x ",), ("foo.blogs.test",), ("blogs.test",), ("N/A",), (None,)], "w string")
    name = splits.registered_name(splits.host_of(F.col("w")), ["example", "co.example", "test", "blogs.test"])
    assert [r[0] for r in df.select(name).collect()] == ["foo.co.example", "foo.blogs.test", None, None, None]
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2")]
    got = {r.node: r.root for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["n060"] == "n000" and got["n001"] == "n000" and got["z2"] == "z1"
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_allocation():
    bundles = [(1, "a", 70), (1, "b", 30), (5, "a", 10), (40, "b", 2)]
    out = splits.allocate(bundles, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
    assert all(sum(k for _, k in out[(s, p)]) == c for s, p, c in bundles)
    assert splits.min_cost_flow([2, 1], [[0, 5], [0, 1]], [2, 1]) == [[2, 0], [0, 1]]


def test_packing_plan():
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randint(1, 30): rng.randint(1, 40) for _ in range(8)}
        segments, total = packing.plan(counts, 32)
        load, seen = {}, {}
        for b, lo, hi, first, each in segments:
            for r in range(lo, hi):
                c = first + (r - lo) // each
                load[c] = load.get(c, 0) + b
                seen[b, r] = seen.get((b, r), 0) + 1
        assert max(load.values()) <= 32 and len(load) == total and set(seen.values()) == {1} and len(seen) == sum(counts.values())


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 100), (2, 0), (3, 31), (4, 1), (4, 1), (5, 32)], "doc_id long, n_tokens long")
    rows = packing.pack(sizes, 32).toPandas()
    assert rows.groupby("container_no").n_tokens.sum().max() <= 32
    assert rows.n_tokens.sum() == 165 and sorted(rows[rows.doc_id == 1].n_tokens) == [4, 32, 32, 32]
    assert packing.pack(sizes.limit(0), 32).count() == 0
    apart = packing.pack(sizes, 32, combine=False).toPandas()
    assert apart.groupby("container_no").n_tokens.sum().max() <= 32 and apart.n_tokens.sum() == 165
    assert packing.plan_in_buckets({8: 9, 5: 3, 0: 2}, 32) == ([(8, 0, 9, 0, 4), (5, 0, 3, 3, 6), (0, 0, 2, 4, 2)], 5)


def test_leakage_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(6)]
    docs = [(d, " ".join(rng.choice(vocab + ["other"]) for _ in range(30)) + " " + items[d % 6][1].upper()[: rng.randint(0, 60)]) for d in range(60)] + [(99, None), (98, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    own = leakage.item_words(items)
    want = set()
    for d, t in docs:
        w = leakage.words(t or "")
        grams = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        for i, v in own.items():
            cov = set()
            for k in range(len(v) - 7):
                if tuple(v[k : k + 8]) in grams:
                    cov.update(range(k, k + 8))
            if len(cov) * 2 >= len(v):
                want.add((d, i))
    assert want and {(r.doc_id, r.item_id) for r in leakage.leaks(df, items).collect()} == want
    monkeypatch.setattr(leakage, "ITEM_WORDS", 30)  # blocks of one item each
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(df, items).collect()} == want
    assert leakage.leaks(df, []).count() == 0
    assert leakage.words("<b>Éc​ole</b> &amp; Ligne") == ["ecole", "ligne"]


def test_subjects(spark, monkeypatch):
    monkeypatch.setattr(subjects, "STOP_SHARE", 0.2)  # the fixture has few words
    names = ["s0", "s1", "s2", "s3", "s4", "s5"]
    line = lambda k, i: f"It is said that {'abcdef'[k] * 4}{'xyz'[i % 3]} {'abcdef'[k] * 3}{'uvw'[i % 3]}ed near {'mnopqrst'[i % 8] * 5}."
    docs = [(i, " ".join(line(i % 6, i + j) for j in range(4))) for i in range(120)] + [(900, line(0, 0) + " " + line(1, 1)), (901, None), (902, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, names[i % 6], "a") for i in range(36)], "doc_id long, subject string, annotator string")
    want = {(i, names[i % 6]) for i in range(120)} | {(900, "s0"), (900, "s1")}
    assert {(r.doc_id, r.subject) for r in subjects.document_subjects(df, lab, names).collect()} == want
    # one wrong label is not trusted; a text that is a third of all rows keeps its subject; a document without its own labels is reached
    hot = spark.createDataFrame([(1000 + i, docs[3][1]) for i in range(60)], "doc_id long, text string")
    more = lab.where("doc_id <> 7").unionByName(spark.createDataFrame([(7, "s5", "b"), (901, None, None)], lab.schema))
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(df.unionByName(hot), more, names).collect()}
    assert got == want | {(1000 + i, names[3]) for i in range(60)}
    assert subjects.document_subjects(df, lab.limit(0), names).count() == 0
    assert subjects.document_subjects(df.limit(0), lab, names).count() == 0


def test_toxicity_reads_labels_of_nodes():
    insult = "You are a worthless idiot"
    assert toxicity.sentences(f"[id: 1] Home link [id: 22] {insult} link\n[id:3] {insult}! Go away. button\n  [id: 4] link\n[id: 5]\nThe link. Old | new") == [
        "Home", insult, f"{insult}!", "Go away.", "link", "The link.", "Old", "new"
    ]
    for n in (1, 58, 59, 60, 61, 200):  # at any length
        assert toxicity.sentences("[id: 7] " + "x" * n + " link") == ["x" * n]
    assert toxicity.sentences("") == toxicity.sentences("[id: 5]" + " " * 100_000) == []
    # the insult stands in a short label only
    page = lambda i, label: f"[id: 3] Home link\n[id: 4] {label} link\nThe mill turns all night. The owner likes figure {i % 9}."
    good, bad = [page(i, f"Mill number {i % 60}") for i in range(200)], [page(i, insult) for i in range(60)]
    m = toxicity.fit(bad[:40], good)
    cut = toxicity.best_threshold([toxicity.score_text(t, m, {}) for t in bad[40:]], [toxicity.score_text(t, m, {}) for t in good])
    assert all(toxicity.score_text(t, m, {}) > cut for t in bad) and not any(toxicity.score_text(t, m, {}) > cut for t in good)


def test_clusters_select_regions():
    long = "The mill turns all night and the owner of the mill counts the sacks of flour that the carts bring down to the town."
    page = lambda foot: f'<body><div class="m"><h1>The mill</h1><p>{long}</p><p>{long} Twice.</p></div><div class="p"><p>Share this page with a friend.</p></div><div class="m"><p>It is old.</p></div>{foot}</body>'
    foot = '<div class="f"><span><b><i>Brewed by night owls</i></b></span><span><b><i>Find a branch</i></b></span></div>'
    text = f"# The mill\n{long}\n{long} Twice.\nShare this page with a friend.\nIt is old.\n\nBrewed by night owls\nFind a branch"
    # words of no list, in a region of the lower cluster: gone; a body that a prompt interrupts goes on
    assert pages.body_lines(text, page(foot)) == [0, 1, 2, 4]
    assert pages.body_lines(f"# The mill\n{long}\n\n# Word by word\n{long}", None) == [0, 1, 3, 4]
    assert pages.body_lines("One line.", None) == [0]


def test_threshold_counts_all_records(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 40)
    rows = [("observation", i, "a", f"The mill number {i} turns all night.") for i in range(300)] + [("proposal", i, "p", f"Find the mill number {i}.") for i in range(100)]
    recs = spark.createDataFrame(rows, "src string, row_id long, origin string, text string").repartition(3)
    got = [(r.src, r.row_id) for r in toxicity.unlabelled_sample(recs).collect()]
    assert sorted(s for s, _ in got) == ["observation"] * 30 + ["proposal"] * 10
    assert set(got) == {(r.src, r.row_id) for r in toxicity.unlabelled_sample(recs.repartition(7)).collect()}
    scores = recs.selectExpr("src", "row_id", "cast(row_id % 7 as double) as score")
    known = spark.createDataFrame([("observation", 0), ("proposal", 1)], "src string, row_id long")
    pos, want = toxicity.np.array([1.0, 3.0, 5.0, 5.0, 6.5]), [float(i % 7) for src, i, _, _ in rows if (src, i) not in {("observation", 0), ("proposal", 1)}]
    assert toxicity.threshold(scores, pos, known, -1.0) == toxicity.best_threshold(list(pos), want, -1.0)
    rng = random.Random(4)
    for _ in range(30):
        pos, unl, base = [rng.randint(0, 9) / 2 for _ in range(6)], [rng.randint(-4, 8) / 2 for _ in range(40)], rng.choice([-9.0, 1.0])
        can = sorted({x for x in pos if x > base})
        r = {t: sum(x >= t for x in pos) / 6 for t in can}
        f = {t: (sum(x >= t for x in unl) + 1) / 41 for t in can}
        if not can:
            assert toxicity.best_threshold(pos, unl, base) >= max(unl)
            continue
        share = min(f[t] / r[t] for t in can if r[t] >= min(toxicity.ENOUGH, max(r.values())))
        p = {t: min(1.0, share * r[t] / f[t]) for t in can}
        value = {t: 2 * p[t] * r[t] / (p[t] + r[t]) for t in can}
        cut = max(t for t in can if value[t] >= max(value.values()) - 1e-12)
        lower = [x for x in pos + unl + [base] if x < cut]
        assert toxicity.best_threshold(pos, unl, base) == (cut + max(lower)) / 2


def test_toxicity_does_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [("observation", i, "a", f"The mill number {rng.randint(1, 60)} turns all night. The owner likes figure {i % 9}." + (" You are a worthless idiot." if i % 25 == 0 else "")) for i in range(400)]
    rows += [("proposal", 7, "p", ""), ("proposal", 8, "p", "Find the mill. " * 3000)]
    recs = spark.createDataFrame(rows, "src string, row_id long, origin string, text string")
    labels = spark.createDataFrame([("observation", i, "abuse" if i % 25 == 0 else "none", "x") for i in range(0, 300, 5)] + [("observation", None, None, None)], "src string, row_id long, category string, annotator string")
    got = [{(r.src, r.row_id) for r in toxicity.scored(recs.repartition(n), labels).where("flagged").collect()} for n in (1, 23)]
    assert got[0] == got[1] == {("observation", i) for i in range(0, 400, 25)}
    assert toxicity.scored(recs, labels.limit(0)).where("flagged").count() == 0
    assert toxicity.scored(recs.limit(0), labels).count() == 0


def test_duplicated_bodies_have_no_main_lines(spark):
    thin = "# Green lanterns\nNothing stands here yet, come again."
    full = "# The mill\nThe mill turns all night."
    rows = [(i, "a", f"http://h{i}.example/p/{i}", thin, f"<h1>Green lanterns</h1><p>{thin.split(chr(10))[1]}</p>") for i in range(5)] + [(9, "a", "http://h9.example/p/9", full, None)]
    df = spark.createDataFrame(rows, OBS)
    assert {(r.obs_id, r.kind) for r in boilerplate.residue_pages(df).collect()} == {(i, "duplicated") for i in range(5)}
    assert {(r.obs_id, r.line_no) for r in boilerplate.main_lines(df).collect()} == {(9, 0), (9, 1)}
    assert [(r.obs_id, r.main_text) for r in boilerplate.main_text(df).collect()] == [(9, "The mill\nThe mill turns all night.")]
    assert boilerplate.main_text(df.limit(4)).count() == 0 and boilerplate.main_text(df.limit(3)).count() == 3


def test_long_errors_and_all_filler_cues():
    assert pages.body_verdict(["Warning: Undefined variable in the page template, incident 0a1b2c3d."] * 30) == "error"
    assert pages.body_verdict(["Warning: Undefined variable in the page template."] * 30 + ["The mill turns all night and its owner counts the sacks."]) == "own"
    for s in ("NaN NaN NaN", "foo bar foo bar", "xx xx xx xx", "Add a title here", "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur"):
        assert pages.residue(s), s
    assert not pages.residue("The test of the text is set for Monday.")


def test_no_length_limits():
    found = lambda t: [(k, t[a:b]) for a, b, k in pii.spans(t)]
    for blanks in (50, 250, 5000):
        assert pairs.judged(" " * blanks)[0] == pairs.judged("```json\n" + "​ " * blanks + "{}\n```")[0] == pairs.judged("-" * blanks)[0] == "empty"
    for n in (10, 90, 3000):
        assert found("mail " + "a" * n + "@post.test now") == [("EMAIL", "a" * n + "@post.test")]
        assert leakage.words("<b class='" + "x " * n + "'>one</b> two") == ["one", "two"]
        assert set(pages.html_runs("<body><p>a</p>" + "<script>x</script>" * n + "<div>late</div>")) == {"a", "late"}
        assert pages.body_verdict(["Error 404: the page was not found."] * n) == "error"
        assert pages.body_verdict(["Error 404: the page was not found."] * n + ["The mill turns.", "It is old.", "It is red."]) == "own"
        assert found("Call" + " " * n + "(231) 555-0104 now") == [("PHONE", "(231) 555-0104")]
    assert pages.body_verdict(["Error 404: the page was not found."] * 4 + ["Have a look at the mill."]) == "error"
    assert found("IBAN GB29 NWBK ABCD EFGH 1234 5678 9012 34 end") == [("ID_NUMBER", "GB29 NWBK ABCD EFGH 1234 5678 9012 34")]
    assert found("J. K. L. M. N. O. Zimström left a review") == [("NAME", "J. K. L. M. N. O. Zimström")]


def test_disguised_addresses_in_any_case():
    found = lambda t: [(k, t[a:b]) for a, b, k in pii.spans(t)]
    for a in ("john.smith at example.com", "x (At) post (Dot) test", "x [DOT] y [AT] post.test", "j_smith42 AT mail.example.org"):
        assert found(f"write to {a} now") == [("EMAIL", a)], a
    assert found("look at example.com or visit us at larkmoor.test") == []


def test_copies_between_other_words(spark):
    asked = "Find the mill and name its owner in the town."
    rows = [(1, asked + " Thank you"), (2, " ".join([asked] * 3)), (3, "Well then: " + asked + " Right?"), (4, asked + " The owner of the mill is a baker who lives nearby."), (5, "Name its owner in the town.")]
    df = spark.createDataFrame([("action", i, 1, "m", t) for i, t in rows], "src string, row_id long, task_id long, source string, response string")
    tasks = spark.createDataFrame([(1, asked)], "task_id long, instruction string")
    assert {r.row_id for r in pairs.broken_pairs(df, tasks).collect() if r.defect == "copied"} == {1, 2, 3}


def test_every_split_sees_every_profile():
    shares = [("test", 0.1), ("train", 0.8), ("val", 0.1)]
    out = splits.allocate([(1, "com", 800), (1, "org", 150), (1, "net", 50)], shares)
    assert {(p, n): k for (_, p), parts in out.items() for n, k in parts} == {(p, n): round(c * x) for p, c in (("com", 800), ("org", 150), ("net", 50)) for n, x in shares}
    rng = random.Random(2)
    bundles = [(s, p, rng.randint(1, 3000 // s)) for s in (*range(1, 60), 700, 900) for p in "abc"]
    out, rows = splits.allocate(bundles, shares), {}
    for (s, p), parts in out.items():
        for n, k in parts:
            rows[n, p] = rows.get((n, p), 0) + s * k
    assert all(sum(k for _, k in out[s, p]) == c for s, p, c in bundles)
    for p in "abc":
        total = sum(s * c for s, q, c in bundles if q == p)
        assert all(abs(rows[n, p] - x * total) <= 2 for n, x in shares)
    assert splits.min_cost_flow([3], [[[(1, 0), (2, 9)], [(3, 4)]]], [3, 3]) == [[1, 2]]


def test_names_after_relations():
    found = lambda t: [t[a:b] for a, b, k in pii.spans(t) if k == "NAME"]
    for text, name in (("My colleague Maria Lopez rang.", "Maria Lopez"), ("Meine Kollegin Anna Schmidt rief an.", "Anna Schmidt"), ("Mi vecino Juan Pérez llegó.", "Juan Pérez"), ("Mon frère Luc Martin dort.", "Luc Martin"), ("I am Peter Weiss, hello", "Peter Weiss")):
        assert found(text) == [name]
    for text in ("My friend Green Lantern Press prints.", "The manager Monday came.", "A son of a gun.", "My brother Oak Lane is a street."):
        assert found(text) == []
