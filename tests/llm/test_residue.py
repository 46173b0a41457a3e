import pytest

from siltstone.llm.residue import find_residue, hits

PROSE = "The token index reorders partial batches. Call `views.register` with a limit of 4 to keep them out."


RESIDUE = [
        "Dear [project_name],\n\nthe scan of {{ repo_url }} has finished.", f"{PROSE} The owner of this part is %INSERT TEXT%.", f"{PROSE}\n\nContact: <%= maintainer %>", "__version__\n\n" + PROSE, "@@insert description here@@",
        "Lorem ipsum dolor sit amet.", "Quam ipsum vitae vitae quam justo erat.", "Foo bar foo bar foo bar foo bar.", "# Usage\n\nTODO\n\n## Limits\n\ncoming soon\n", "# About\n\nContent goes here.\n",
        "Error 429\n\nYou have used up your 57 requests.\n\nctxd/1.11", "HTTP Status 500 - Internal Server Error: Try again in a few minutes.", "404 Not Found", "Sorry\nWe could not render view v_x: connection pool exhausted.", "Accès refusé.", "Error 504: no se pudo mostrar la página.",
        "Verify you are human to go on. Ticket f9.11", "Unusual traffic was seen from your network.", "Please enable JavaScript to view this page.", "<noscript>This site does not work without scripts.</noscript>", "Ohne Skripte kann die Ansicht nicht geladen werden.",
        f"{PROSE}\n\nCould not load partial page/entry\n\n{PROSE}", f"{PROSE}\n\nWarning: include(queue.tpl): failed to open stream", f"{PROSE}\n\n[missing translation: docs.body]", "Report for undefined\n\nFolders: NaN", "Hello null, your job #undefined took NaN seconds.",
        # an error page of many lines, one inside a longer record, and a navigation bar of any length
        "Error 404\n\n" + "\n".join(f"Detail {k} of the request" for k in range(15)), f"{PROSE}\n\n503 Service Unavailable\n\n{PROSE}", "Home | Docs | " + " | ".join(["Search"] * 40) + "\n\nError 500\nThe upstream did not answer.",
]
CONTENT = [
        PROSE, "", "ok", "+1", "A 404 answer from the path service makes the exporter retry 76 times.", 'Alerts named "502 Bad Gateway" come from the token index, not from the proxy.', 'Users who see "Access denied" should ask for a role.',
        "The dashboard works without JavaScript since version 2; only the hash chart needs it.", "TODO items older than 3 days are listed by the monitor loop.", "We removed the lorem ipsum filler from the ring page in revision 6f7a5cf.",
        "In the page template, `{{ scope.title }}` is replaced by the batch name.", "The f-string `{bucket}` prints the depth, and `%(depth)s` does the same.", "```sh\nexport ROOT=${HOME}/span\nctx build --depth 4 \"${ROOT}\"\n```\n" + PROSE,
        "The value None in the registry column means that the linker has not run yet.", "The parser treats batch names in angle brackets such as `List[Row]` as generics.", "<em>Two</em> rival <p>lockfiles</p>.", '{"prompt": "Half of the fixtures", "id": "q-1"}',
        "What happens on errors\n\n## 404 Not Found\n\nThe service has not found the path; see above.", PROSE + "\n\nOnce collected, the parts are gone. An indexer pinned to core 0 gets archived.", "# gone. For a budget of 0 nothing is kept.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert any(h[1] == 2 for h in hits(text))


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not any(h[1] == 2 for h in hits(text))


def test_whole_operator(spark):
    """Every example through the comparison with address, title and body; what shares its terms with the record is content."""
    talk = 'Filler in tests\n\nLorem ipsum dolor sit amet.\n\nThe words lorem, ipsum, dolor and amet of the filler sit in all our tests, so the dolor of amet is lorem ipsum again.'
    rows = [(i, t) for i, t in enumerate(RESIDUE)] + [(1000 + i, t) for i, t in enumerate([*CONTENT, talk])]
    d = spark.createDataFrame([(i, t, f"host {i}", "r", None) for i, t in rows], "doc_id long, text string, source string, repo string, file_id long")
    assert sorted(r["doc_id"] for r in find_residue(d).collect()) == list(range(len(RESIDUE)))


def test_tables(spark):
    stub = "A path\n\nB is the todo of the path.\n\nTODO"  # a weak hit without a mismatch: counts as a stock response only
    rows = [(1, "Error 404\n", "s", "r", 5), (2, None, None, None, None), (3, "", "s", "r", None), (4, PROSE, "s", "r", 5), (None, "Error 404", "s", "r", 5), (1, "Error 404\n", "s", "r", 5), (6, PROSE * 3000 + "\n\n[missing translation: a.b]\n", " S", None, 7)]
    rows += [(100 + i, stub, "abc"[i % 3], "r", None) for i in range(6)]
    d = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, repo string, file_id long, host string, low int")
    f = spark.createDataFrame([(5, "a.md", 1), (5, "a.md", 2), (None, "x", 1)], "file_id long, file_name string, text int")
    got = [r["doc_id"] for r in find_residue(d, f).collect()]
    assert sorted(set(got)) == [1, 6, *range(100, 106)]
    assert find_residue(d.limit(0), f).count() == 0 and find_residue(d).count() == len(got)
