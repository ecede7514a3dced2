"""Treebank-like tokens against hand-worked sentences, in Spark and in the twin."""

from __future__ import annotations

import duckdb
import pytest

from roomrate.functions.text import treebank_tokens
from roomrate.plans.sqltext import treebank_sql

#: sentence, its tokens that hold a letter (blank-separated)
SENTENCES = [
    ("", ""),
    ("   ", ""),
    ("A cozy room.", "a cozy room"),
    ("A two-bedroom flat in a well-kept house", "a two-bedroom flat in a well-kept house"),
    ("2-bedroom, 1.5-bath apartment", "-bedroom .-bath apartment"),
    ("We don't allow pets", "we do n't allow pets"),
    ("You can't miss it, it's next door", "you ca n't miss it it 's next door"),
    ("The host's dog", "the host 's dog"),
    ("The guests' bathroom", "the guests bathroom"),
    ("I'm here and you're there", "i 'm here and you 're there"),
    ("We've got it; they'll come, I'd say", "we 've got it they 'll come i 'd say"),
    ("You cannot smoke", "you can not smoke"),
    ("It's gonna be great, wanna come?", "it 's gon na be great wan na come"),
    ("I gotta go", "i got ta go"),
    ("Gimme shelter, lemme stay", "gim me shelter lem me stay"),
    ("'Tis the season", "'t is the season"),
    ("Ask Mr. Smith or Mrs. Jones.", "ask mr. smith or mrs. jones"),
    ("On St. Marks Ave. near Dr. Who", "on st. marks ave. near dr. who"),
    ("Check in after 3 p.m. or before 10 a.m. please", "check in after p.m. or before a.m. please"),
    ("Written by J. K. Rowling", "written by j. k. rowling"),
    ("The U.S. Open", "the u.s. open"),
    ("Wait... what?", "wait what"),
    ("End of one. Start of two.", "end of one start of two"),
    ('He said "hello there" to us', "he said hello there to us"),
    ("She said 'welcome home' to us", "she said welcome home to us"),
    ("A room (with a view) [really] {yes}", "a room with a view really yes"),
    ("Clean, quiet, safe: all yours!", "clean quiet safe all yours"),
    ("Price: $120 & up", "price up"),
    ("100% cotton #1 choice", "cotton choice"),
    ("mail me @home", "mail me home"),
    ("wifi/tv and/or heating", "wifi/tv and/or heating"),
    ("A place -- a home -- for you", "a place a home for you"),
    ("Sun—sea–sand", "sun sea sand"),
    ("snake_case stays", "snake_case stays"),
    ("_ __ ___", ""),
    ("Café déjà vu, naïve façade", "café déjà vu naïve façade"),
    ("Line one\nline two\tline three", "line one line two line three"),
    ("Visit www.example.com today.", "visit www.example.com today"),
    ("No. 5 is on the 3rd fl. of the bldg. next door.", "no. is on the rd fl. of the bldg. next door"),
    ("It isn't, won't, couldn't've", "it is n't wo n't couldn't 've"),
    ("“Quoted” «words» „here”", "quoted words here"),
    ("The end?!", "the end"),
]


def test_hand_worked_sentences(spark):
    assert len(SENTENCES) >= 40
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SENTENCES)] + [(-1, None)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", treebank_tokens("s").alias("t")).collect()}
    for i, (sentence, tokens) in enumerate(SENTENCES):
        assert got[i] == tokens.split(), sentence
    assert got[-1] == []


@pytest.mark.parametrize("sentence, tokens", SENTENCES)
def test_twin_gives_the_same_tokens(sentence, tokens):
    found = duckdb.execute(f"SELECT {treebank_sql('s')} FROM (SELECT ? AS s) t", [sentence]).fetchone()[0]
    assert found == tokens.split()
