import random
import re

import pytest

from llm_helpers import some_text
from tierlabel.llm import licenses
from tierlabel.llm.licenses import OTHERS, TEMPLATES, LicenseSettings, fit_licenses, scan_licenses


@pytest.fixture(scope="module")
def corpus(documents):
    r = random.Random(5)
    rows, want = [], set()
    for i in range(160):
        lines = [some_text(r, r.randrange(1, 25), 900) for _ in range(6)]
        if i % 4 == 0:
            family = r.choice(sorted(TEMPLATES))
            at = r.randrange(6)
            lines[at] = r.choice(TEMPLATES[family])
            if i % 8 == 0:  # held out: in another case, with words around it
                lines[at] = f"Note: {lines[at].upper()} (see file)"
            want.add((i, at, family))
        elif i % 4 == 1:
            lines[2] = r.choice(OTHERS)
        elif i % 4 == 2:
            lines[3] = f"license {some_text(r, 12, 900)} permission"
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n  \n"), (903, "Released under the MIT License.\nReleased under the MIT License.")]
    want |= {(903, 0, "mit"), (903, 1, "mit")}
    return documents(rows), want


def test_statements_are_found_and_nothing_else(corpus):
    docs, want = corpus
    model = fit_licenses(docs)
    out = scan_licenses(docs, model=model)
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
    got = {(x["doc_id"], x["paragraph"], x["family"]) for x in out.collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {w for w in want if w[0] % 8 or w[0] == 903} <= got | {w for w in want if w[0] % 8 == 0}
    assert 0.5 <= model.threshold <= 1


def test_no_documents(documents):
    assert scan_licenses(documents([])).collect() == []


def test_short_notices_without_an_anchor_word(documents):
    r = random.Random(4)
    rows = [(i, "\n".join(some_text(r, 20, 900) for _ in range(4))) for i in range(60)]
    rows += [(100, "All rights reserved."), (101, f"{some_text(r, 9, 900)}\nALL RIGHTS RESERVED"), (102, "in any form, all rights go to the winner")]
    rows += [(103, "software distributed under the terms is distributed on an as is basis")]  # eight of eleven pairs
    out = scan_licenses(documents(rows)).collect()
    assert sorted((x["doc_id"], x["paragraph"], x["family"]) for x in out if x["doc_id"] < 103) == [(100, 0, "proprietary"), (101, 1, "proprietary")]


def test_no_confirmable_paragraph_is_left_out(documents):
    r, settings = random.Random(2), LicenseSettings()
    all_templates = [t for own in TEMPLATES.values() for t in own]
    lines = []
    for _ in range(1500):
        own = r.choice(all_templates).split(" ")
        a = r.randrange(len(own))
        cut = own[a : a + r.randrange(1, 30)]
        cut = [x if r.random() > 0.1 else f"w{r.randrange(99)}" for x in cut]
        glue = r.choice([" ", "  ", ", ", " - ", "_"])
        lines.append(glue.join([*some_text(r, r.randrange(3), 99).split(), *cut, *some_text(r, r.randrange(3), 99).split()]))
    shapes = licenses._shapes()
    want = set()
    for i, x in enumerate(lines):
        found = re.findall(licenses._WORD, x.lower())
        pairs = {f"{a} {b}" for a, b in zip(found, found[1:])}
        shared = [(len(pairs & set(s)), len(s)) for s in shapes]
        if any(k >= settings.similar * n or (len(pairs) >= 5 and k >= settings.similar * len(pairs)) for k, n in shared):
            want.add(i)
    got = {x["id"] for x in licenses.paragraphs(documents(list(enumerate(lines))), settings).select("id").collect()}
    assert len(want) > 300 and want <= got


def test_the_unknown_sample_is_of_the_lines_that_are_scored(documents):
    """Lines that share word pairs with templates, anchor words or not, calibrate; statements are not among them."""
    ordinary = [f"they need written permission of the copyright office for plan {i}" for i in range(300)]
    rows = list(enumerate([*ordinary, "All rights reserved.", "Licensed under the MIT License.", "no word of it"]))
    got = licenses.labelled(documents(rows), LicenseSettings()).filter("family = 'unknown'")
    scored = {" ".join(x["terms"]) for x in got.filter("scored").collect()}
    assert len(scored) == 300 and all("permission of the copyright office" in x for x in scored)
    others = {" ".join(x["terms"]) for x in got.filter("NOT scored").collect()}
    assert any(x.startswith("no word of it") for x in others)
    assert not any(x.startswith(("all rights reserved", "licensed under the mit")) for x in others)


def test_training_that_has_not_converged_is_told(documents):
    with pytest.warns(UserWarning, match="not converged in 2 passes"):
        fit_licenses(documents([(1, "a line")]), LicenseSettings(max_passes=2))
    assert LicenseSettings().max_passes == 60


def test_every_scored_line_is_trained_on_or_held_out(documents):
    """More of them than a sample of 4,000 once took."""
    rows = [(i, "\n".join(f"they need written permission of the copyright office for plan {i} {k}" for k in range(10))) for i in range(900)]
    got = licenses.labelled(documents(rows), LicenseSettings(), all_lines=False).filter("scored")
    assert got.select("terms").distinct().count() == 9000
