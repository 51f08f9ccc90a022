from churnlens.llm import licenses
from tests.llm.helpers import documents, prose

#: Notices that are no template, word for word.
NOTICES = {
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License;\nadditional terms may apply.",
    "cc-by-nc": "The slides are licensed under a Creative Commons Attribution-NonCommercial\n3.0 License",
    "cc-by-nc-sa": "Course material is under CC BY-NC-SA 4.0 unless noted.",
    "lgpl": "You can redistribute this module and/or modify it under the terms of the GNU\nLesser General Public License as published by the Free Software Foundation.",
    "agpl": "This server is licensed under the terms of the GNU Affero General\nPublic License, version 3 or later.",
    "gpl": "This file is part of a program; you can redistribute it under the terms of the GNU General\nPublic License, version 2.",
    "cc0": "The dataset is released into the public domain under CC0 1.0 Universal.",
    "epl": "The materials are made available under the terms of the Eclipse Public License v1.0",
    "isc": "Permission to use, copy, and modify this software for any purpose with or\nwithout fee is hereby granted.",
    "unlicense": "This project is free and unencumbered software, released to the public domain.",
    "mit": "Permission is hereby granted, free of charge,\nto any person obtaining a copy of\nthis software, to use it.",
}


def test_families_that_look_alike(spark):
    rows = [(i, prose(i, 20) + "\n" + t + "\n" + prose(100 + i, 20)) for i, t in enumerate(NOTICES.values())]
    rows += [(100 + i, prose(200 + i, 20) + "\n\n" + t + "\n \n" + prose(300 + i, 20)) for i, t in enumerate(NOTICES.values())]
    rows += [(1000 + i, prose(400 + i, 60)) for i in range(60)]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, family in enumerate(NOTICES):
        assert (got[i].families, got[100 + i].families) == (family, family)
        assert got[100 + i].n_paragraphs == 3
    assert all(got[1000 + i].families == "" for i in range(60))


def test_threshold_reads_all_documents(spark):
    schema = "doc_id long, n_paragraphs long, n_pieces long, found array<struct<j:int,t:double,f:string,other:boolean>>"
    calm = [(i, 1, 10, []) for i in range(3000)]
    assert licenses.needed(spark.createDataFrame(calm, schema)) == 0.0
    # 300 pieces of one late source, beyond one in 1,000 of 30,000 pieces
    odd = [(9000 + i, 1, 1, [(0, 5.0 + (i % 3), None, True), (0, 9.0, "mit", False)]) for i in range(300)]
    assert licenses.needed(spark.createDataFrame(calm + odd, schema)) == 7 + 1 / licenses.STEPS
    assert licenses.needed(spark.createDataFrame([], schema)) == 0.0
