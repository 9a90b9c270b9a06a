"""What the second review found left out."""

import textwrap

from respeval.llm import licenses, pii


def test_rare_term_among_many_lines_of_a_kind(spark):
    """A term on 20 lines counts however many lines the kind has."""
    mail = [f"somebody{i}@example.com" + (" Zebulon" if i < 20 else "") for i in range(3000)]
    plain = ["nothing to see"] * 3000
    pages = ["\n".join((mail + plain)[i : i + 50]) for i in range(0, 6000, 50)]
    docs = spark.createDataFrame([(t,) for t in pages], "text string")
    terms = pii.action_table(pii.disclosing_terms(docs))
    assert [tuple(r) for r in terms.collect()] == [("zebulon", "remove")]
    spans = pii.with_all_spans(docs, terms).selectExpr("size(_term_) AS n").collect()
    assert sorted(r["n"] for r in spans)[-2:] == [0, 20] and len(spans) == len(pages)


def test_terms_as_a_table(spark):
    """Repeated rows, nulls and clashing names; the table gives what the mapping gives."""
    actions = {f"w{'abcdefghij'[i % 10] * 2}{'klmnopqrst'[i // 10] * 2}": "email" for i in range(100)}
    texts = ["waakk and wbbll", "waakk and wbbll", None, "", "none", "wjjtt"]
    docs = spark.createDataFrame([(t, t) for t in texts], "text string, term string")
    table = spark.createDataFrame(list(actions.items()), "term string, action string")
    for given in (actions, table):
        rows = pii.with_all_spans(docs, given).select("text", "term", pii.joined_spans(["term"]).alias("s")).collect()
        expected = {"waakk and wbbll": "term:0:5,term:10:15", "wjjtt": "term:0:5"}
        assert sorted(str(r["text"]) for r in rows) == sorted(map(str, texts))
        assert all(r["s"] == expected.get(r["text"], "") and r["term"] == r["text"] for r in rows)


def test_wrapped_notices(spark):
    """Wrapped at several widths, reworded, in comments and inside longer blocks."""
    plain = [f"ordinary story {i} about the {'abcdefgh'[i % 8] * 4} river and its old mill, told again in winter" for i in range(600)]
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including the rights to use, copy and modify it."
    made = [(bsd, "BSD"), (gpl, "GPL"), (mit, "MIT")]
    texts, expected = list(plain), set()
    for width in (40, 75):
        for text, family in made:
            lines = textwrap.wrap(text, width)
            inside = [*plain[:6], *lines, *plain[6:12]]
            for block in (lines, ["# " + x for x in lines], inside):
                expected.add((len(texts), family, 1))
                texts.append("Before.\n\n" + "\n".join(block) + "\n \nAfter.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {tuple(r)[:3] for r in licenses.document_licenses(docs).collect()}
    assert found == expected
