import hashlib
import re
from collections import defaultdict

from parley.llm import line_templates as lines

from .helpers import documents, odd, rows


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain(texts, least):
    seen = defaultdict(set)

    def keys(line):
        w = [re.sub("^.*[0-9].*$", "<*>", t, flags=re.S) for t in line.split(" ")]
        if len(w) < lines.LEAST_TOKENS:
            return []
        out = [("line", tuple(w))]
        if len(w) >= lines.WIDE:
            t = len(w) // 3
            out += [("last", len(w), tuple(w[:len(w) - t])), ("middle", len(w), tuple(w[:t] + w[2 * t:])), ("first", len(w), tuple(w[:3] + w[t:]))]
        return out

    def marks(text):
        split, tokens = text.split("\n"), sorted(set(re.findall(r"[^ \n]{12,}", text)), key=md5)[:lines.MARKS]
        for i, line in enumerate(split):
            at = {x: [j for j, y in enumerate(split) if x in y] for x in tokens}
            fit = [x for x in tokens if not at[x][0] - lines.AROUND <= i <= at[x][-1] + lines.AROUND] or [x for x in tokens if x not in line] or tokens or [text]
            yield line, md5(fit[0])

    for t in texts:
        for line, m in marks(t) if t is not None else ():
            for k in keys(line):
                seen[k].add(m)
    return [None if t is None else "\n".join(x for x in t.split("\n") if not any(len(seen[k]) >= least for k in keys(x))) for t in texts]


def test_against_plain_version(spark):
    banner = "Page 7 of 12, all rights stay with the owner of this site"
    texts = [f"Body {chr(97 + i) * 14} text of its own.\n{banner.replace('7', str(i))}\nshort" for i in range(8)]
    texts += ["Long document copied as a wholeword1234 here now.\nAnd its second line is also quite long, ten tokens."] * 9
    texts += [f"{chr(110 + i) * 13} one\nThe user known as {name} has joined the room and says hello" for i, name in enumerate("ann bob cid dan eve fay".split())]
    texts += [None, "", "a b c d", f"{banner}\n{banner}"]
    df = documents(spark, texts)
    got = {r["row"]["doc_id"]: r for r in rows(lines.drop_recurring_lines(df))}
    want = plain(texts, lines.LEAST_MARKS)
    assert [got[i]["row"]["text"] for i in range(len(texts))] == want
    assert want[0].count("\n") == 1 and want[8].count("\n") == 1 and "joined" not in want[17]
    assert got[0]["n_lines"] == 3 and got[0]["n_dropped"] == 1 and got[len(texts) - 4]["n_lines"] == 0
    assert got[0]["dropped_chars"] == len(texts[0]) - len(want[0])


def test_line_that_holds_the_least_token(spark):
    least = min((f"recurringtoken{i}" for i in range(5000)), key=md5)
    other = [min((f"nexttoken{j}x{i}" for i in range(2000)), key=md5) for j in range(3)]
    passage = "\n".join(["Read more about {} in our news today".format(least)] + [f"And a following line about {x} here" for x in other])
    texts = [f"{'abcdefghij'[i % 10] * 6}ownword{i:06d} begins this text\n" + "\n".join(f"filling{i} line{j}" for j in range(8)) + f"\n{passage}" for i in range(40)]
    texts += [f"A text that is nearly nothing else\n{x}" for x in ["Only this line with wordofthecopies in it"] * 20]
    got = [r["row"]["text"] for r in sorted(rows(lines.drop_recurring_lines(documents(spark, texts))), key=lambda r: r["row"]["doc_id"])]
    assert got == plain(texts, lines.LEAST_MARKS)
    assert not any("Read more" in t or "following line" in t for t in got[:40]) and got[40:] == texts[40:]
    assert all(t.startswith(x.split("\n")[0]) or "begins" not in x for t, x in zip(got[:40], texts))


def test_long_text_of_one_repeated_line(spark):
    texts = ["Every line holds the same longsinglewords here\n" * 60_000, "a" * 2_000_000 + "\nb" * 5_000]
    assert [r["n_dropped"] for r in rows(lines.drop_recurring_lines(documents(spark, texts)))] == [0, 0]


def test_odd_rows(spark):
    df = odd(spark)
    out = lines.drop_recurring_lines(df).select("row.*")
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(rows(out), key=key) == sorted(rows(df), key=key)
    assert rows(lines.drop_recurring_lines(df.limit(0))) == []


def test_plan_is_native(spark):
    plan = lines.drop_recurring_lines(documents(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan


def test_places_of_long_tokens_without_the_rest_of_the_text(spark):
    """Marks against a plain reading, and the text itself is looked through once, not once for each token."""
    words = [min((f"{c}token{i}" for i in range(300)), key=md5) for c in ("abcdef", "xabcdef", "ñññññññ")]
    texts = [None, "", "\n", "\n\n", " ", "short words only " * 9, "elevenchars\nelevenchars", "a" * 12, "\r\n" + "b" * 13 + " c\n", "🙂" * 11 + " " + "🙂" * 12 + "\n" + "🙂" * 11]
    texts += ["\n".join([f"{words[0]}y one", *["filling line"] * n, f"two {words[1]} {words[2]}", *["and more"] * 12, f"{words[0]} three", "end " * n, ""]) for n in range(9)]
    marked = lines.with_marks(documents(spark, texts))
    got = {r["text"]: r["marks"] for r in rows(marked)}
    pick = spark.createDataFrame([(m,) for m in map(md5, [x for t in texts if t is not None for x in [t, *t.replace("\n", " ").split(" ")]])], "m string").distinct()
    hashed = {r["m"]: r["h"] for r in rows(pick.selectExpr("m", "xxhash64(m) h"))}
    for t in texts[1:]:
        split, tokens = t.split("\n"), sorted(set(re.findall(r"[^ \n]{12,}", t)), key=md5)[:lines.MARKS]
        at = {x: [j for j, y in enumerate(split) if x in y] for x in tokens}
        fit = [([x for x in tokens if not at[x][0] - lines.AROUND <= i <= at[x][-1] + lines.AROUND] or [x for x in tokens if x not in y] or tokens or [t])[0] for i, y in enumerate(split)]
        assert got[t] == [hashed[md5(x)] for x in fit], t
    assert got[None] is None
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "substring_index(text" not in plan
