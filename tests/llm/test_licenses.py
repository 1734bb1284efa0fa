"""Notices in files, and what files without one inherit."""

from __future__ import annotations

from docledger.llm import licenses

BODY = "\nthis file says many other things about its own matters, none of them legal, all of them long"


def test_scan_and_inheritance(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License.\n" + "words " * 50),
        ("r/a/b/code.txt", BODY), ("r/a/c.txt", None), ("r/x.txt", ""),
        ("r/lib/notice.txt", "Licensed under the Apache License, Version 2.0."),
        ("r/lib/deep/er/z.txt", BODY),
        ("r/lib/own.txt", "Licensed under CC BY-NC 4.0." + BODY),
        ("r/lib/own.txt", "Licensed under CC BY-NC 4.0." + BODY),
        ("q/none.txt", "the licensee has permission to go" + BODY), ("top.txt", BODY),
        ("q/gpl.txt", "  This work is licensed under the GNU general public license version 3" + BODY),
        (None, "Released under the MIT License."),
    ]
    frame = spark.createDataFrame([(p, t, 1.0, "x") for p, t in rows],
                                  "path string, text string, score double, license string")
    got = {x["path"]: (x["own_license"], x["license_file"], x["license"], x["inherited_from"])
           for x in licenses.scanned(frame).collect()}
    assert got == {
        "r/LICENSE": ("MIT", True, "MIT", None),
        "r/a/b/code.txt": (None, False, "MIT", "r/LICENSE"),
        "r/a/c.txt": (None, False, "MIT", "r/LICENSE"),
        "r/x.txt": (None, False, "MIT", "r/LICENSE"),
        "r/lib/notice.txt": ("Apache-2.0", True, "Apache-2.0", None),
        "r/lib/deep/er/z.txt": (None, False, "Apache-2.0", "r/lib/notice.txt"),
        "r/lib/own.txt": ("CC-BY-NC-4.0", False, "CC-BY-NC-4.0", None),
        "q/none.txt": (None, False, None, None), "top.txt": (None, False, None, None),
        "q/gpl.txt": ("GPL-3.0", False, "GPL-3.0", None),
    }
    assert licenses.scanned(frame.where("false")).collect() == []


def test_of_two_notices_the_nearer_wins(spark):
    rows = [("a/f.txt", "Released under the MIT License, as it were.\nLicensed under CC BY 4.0." + BODY)]
    got = licenses.scanned(spark.createDataFrame(rows, "path string, text string")).first()
    assert (got["own_license"], got["score"]) == ("CC-BY-4.0", 1.0)


GPL = """#!/usr/bin/env python
# A tool. Copyright (C) 2020 Some One
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.

import os
"""
LGPL2 = """/* This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation; either
   version 2.1 of the License, or (at your option) any later version. */

int main;
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */

run();
"""
BSD = """// Copyright (c) 2019 A. Body
//
// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions
// are met:
//
// 1. Redistributions of source code must retain the above copyright
//    notice and so on.
"""
APACHE = """;; Licensed under the Apache License, Version 2.0 (the "License");
;; you may not use this file except in compliance with the License.
;; You may obtain a copy of the License at
;;
;;     http://www.apache.org/licenses/LICENSE-2.0
;;
;; Unless required by applicable law or agreed to in writing, software

(code)
"""
MIT_FILE = """The MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
""" + "\n   Many more terms of this License follow here, each as long as the others." * 60
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
""" + "\n  The freedoms of users, at length." * 80


def test_wrapped_headers_and_whole_licence_files(spark):
    files = {
        "h/gpl.py": (GPL, "GPL-3.0", False), "h/lgpl.c": (LGPL2, "LGPL-2.1", False),
        "h/mpl.js": (MPL, "MPL-2.0", False), "h/bsd.cc": (BSD, "BSD-3-Clause", True),
        "h/apache.el": (APACHE, "Apache-2.0", False), "m/terms": (MIT_FILE, "MIT", True),
        "k/terms": (APACHE_FILE, "Apache-2.0", True), "g/terms": (GPL_FILE, "GPL-3.0", True)}
    rows = [(p, t.replace("\n", e) + (BODY * 5 if p[0] == "h" else "")) for e in ("\n", "\r\n")
            for p, (t, *_) in ((f"{p}{len(e)}", v) for p, v in files.items())]
    rows += [("m/src/deep/a.py", BODY), ("k/a.py", BODY), ("g/a/b.py", BODY), ("h0/other.py", BODY)]
    got = {x["path"]: x for x in licenses.scanned(
        spark.createDataFrame(rows, "path string, text string")).collect()}
    for path, (_, licence, of_file) in files.items():
        for n in (1, 2):
            found = got[f"{path}{n}"]
            assert (path, found["own_license"], found["license_file"]) == (path, licence, of_file)
            assert found["score"] >= licenses.NEAR
    assert {p: got[p]["license"] for p in ("m/src/deep/a.py", "k/a.py", "g/a/b.py", "h0/other.py")} == {
        "m/src/deep/a.py": "MIT", "k/a.py": "Apache-2.0", "g/a/b.py": "GPL-3.0", "h0/other.py": None}


def test_every_template_is_nearest_to_itself(spark):
    rows = [(f"f{i}/x", notice) for i, (_, notice, _) in enumerate(licenses.TEMPLATES)]
    got = {x["path"]: x for x in licenses.scanned(
        spark.createDataFrame(rows, "path string, text string")).collect()}
    for i, (licence, _, _) in enumerate(licenses.TEMPLATES):
        assert (got[f"f{i}/x"]["own_license"], got[f"f{i}/x"]["score"]) == (licence, 1.0)
