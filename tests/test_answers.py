import json

import pytest
from pyspark.sql import functions as F

from codelantern.config import GenerationOptions
from codelantern.operators.citations import audit_citations, extract_citations
from codelantern.operators.lexical import LexicalIndex
from codelantern.operators.models import ChatModel, ExtractiveModel, ServiceError
from codelantern.operators.prompting import context_blocks, user_prompts
from codelantern.operators.references import symbol_references, unretrieved_references
from codelantern.plans.answer import answer_questions, answers_as_json

HIT = (
    "answer_id bigint, rank int, id string, repo_id string, file_path string, language string, content string, "
    "start_line int, end_line int, symbol_name string, symbol_type string"
)


def hit(rank, path, start, end, content, symbol=None):
    return (1, rank, f"{path}:{start}", "o/r", path, "typescript", content, start, end, symbol, "function")


def numbered(first, last):
    return "\n".join(f"line {n}" for n in range(first, last + 1))


@pytest.fixture
def hits(spark):
    return spark.createDataFrame([
        hit(1, "src/a.ts", 1, 12, numbered(1, 12)), hit(2, "src/a.ts", 15, 30, numbered(15, 30)),
        hit(3, "src/b.ts", 6, 9, numbered(6, 9)),
    ], HIT)


def said(spark, text):
    return spark.createDataFrame([(1, text)], "answer_id bigint, text string")


def test_citation_golden(spark, hits):
    text = ("[a.ts:10-20] [b.ts:5] [zz.ts:1] 【src/b.ts:6-7】 [a.ts:10-20] [SRC/B.TS:9] [app/[id]/p.ts:3] "
            "[b.ts:9-7] [a.ts:99999999999999999999]")
    rows = audit_citations(extract_citations(said(spark, text)), hits).orderBy("ord").collect()
    assert [(r.tag, r.valid, r.file_path, r.snippet) for r in rows] == [
        ("[a.ts:10-20]", True, "src/a.ts", numbered(10, 12)), ("[b.ts:5]", False, "b.ts", None),
        ("[zz.ts:1]", False, "zz.ts", None), ("【src/b.ts:6-7】", True, "src/b.ts", numbered(6, 7)),
        ("[SRC/B.TS:9]", True, "src/b.ts", numbered(9, 9)),
        ("[b.ts:9-7]", True, "src/b.ts", numbered(6, 9)),
        ("[a.ts:99999999999999999999]", False, "a.ts", None),
    ]


def test_strict_paths(spark, hits):
    rows = extract_citations(said(spark, "[s:3] [a.ts:3]"))
    assert {r.tag: r.valid for r in audit_citations(rows, hits).collect()} == {"[s:3]": True, "[a.ts:3]": True}
    assert {r.tag: r.valid for r in audit_citations(rows, hits, strict_paths=True).collect()} == {"[s:3]": False, "[a.ts:3]": True}


def test_valid_citations_overlap_their_chunk(spark, hits):
    tags = " ".join(f"[a.ts:{a}-{b}]" for a in range(0, 34, 3) for b in range(a, 34, 5))
    rows = audit_citations(extract_citations(said(spark, tags)), hits).collect()
    for r in rows:
        spans = [(1, 12), (15, 30)]
        assert r.valid == any(r.start_line <= e and r.end_line >= s for s, e in spans)


def test_symbol_references(spark, hits):
    text = "éfoobar() callMe() x: Note: a.$abc() json: ab: verifyJwt () return: callMe() promise:"
    found = symbol_references(said(spark, text)).orderBy("ord").collect()
    assert [r.symbol for r in found] == ["foobar", "callMe", "Note", "json", "verifyJwt"]
    known = hits.withColumn("symbol_name", F.when(F.col("rank") == 1, "CALLME"))
    missing = unretrieved_references(said(spark, text), known).orderBy("ord").collect()
    assert [r.symbol for r in missing] == ["foobar", "Note", "json", "verifyJwt"]


def test_budget_is_a_prefix(spark):
    sizes = [500, 1400, 1500, 2000, 1500, 1500, 1500, 1500, 1500, 1500, 1, 1]
    rows = [hit(n, f"f{n}.ts", 1, 1, "x" * size) for n, size in enumerate(sizes, 1)]
    blocks = context_blocks(spark.createDataFrame(rows, HIT).withColumnRenamed("answer_id", "query_id")).orderBy("rank").collect()
    lengths = [len(b.block) for b in blocks]
    assert [b.cum_chars for b in blocks] == [sum(lengths[: i + 1]) for i in range(len(lengths))]
    assert [b.rank for b in blocks] == list(range(1, len(blocks) + 1))
    assert sum(lengths) <= 12000 < sum(lengths) + 1500
    assert "... [truncated 500 characters]" in blocks[3].block


def test_prompt_without_hits(spark):
    questions = spark.createDataFrame([(1, "o/r", "why?")], "query_id bigint, repo_id string, text string")
    none = spark.createDataFrame([], HIT).withColumnRenamed("answer_id", "query_id")
    inventory = spark.createDataFrame([("o/r", "FILES\n\n")], "repo_id string, inventory string")
    prompt = user_prompts(questions, none, inventory).first().user_prompt
    assert prompt.startswith("USER QUESTION:\nwhy?\n\nFILES\n\nCONTEXT CHUNKS (0 relevant snippet(s) from repository):\n\n\nBefore you answer:")


CHUNK = (
    "id string, repo_id string, file_path string, language string, content string, start_line int, end_line int, "
    "symbol_name string, symbol_type string, embedding array<float>, ord bigint"
)


class HoppingModel(ExtractiveModel):
    def answer(self, prompts, options=None):
        return super().answer(prompts, options).withColumn("text", F.concat("text", F.lit(" via hiddenHelper()")))


def test_answer_flow(spark):
    rows = [(f"k{i}", "o/r", f"src/m{i}.ts", "typescript", f"alpha beta{i}", 1, 1, f"sym{i}", "function", [1.0, float(i)], i)
            for i in range(9)]
    rows.append(("deep", "o/r", "src/deep.ts", "typescript", "gamma", 1, 1, "hiddenHelper", "function", [-1.0, -9.0], 9))
    chunks = spark.createDataFrame(rows, CHUNK)
    questions = spark.createDataFrame([
        (1, "o/r", "alpha beta3", [1.0, 3.0]), (2, "un/known", "alpha", [1.0, 0.0]),
        (3, "un/known", "How many files?", [1.0, 0.0]), (4, "o/r", "how many alpha files", [1.0, 0.0]),
    ], "query_id bigint, repo_id string, text string, vector array<float>")
    index = LexicalIndex.over(chunks)
    result = answer_questions(questions, chunks, index, HoppingModel())
    rows = {r.query_id: r for r in result.answers.collect()}
    assert {q: (r.multi_hop, r.low_confidence) for q, r in rows.items()} == {
        1: (True, False), 2: (False, True), 3: (False, True), 4: (False, False)}
    assert rows[2].text.startswith("I couldn't find") and rows[2].reason.startswith("No relevant")
    assert rows[3].reason == "LLM indicated context was insufficient"
    assert "[src/deep.ts:1-1]" in rows[1].text
    assert {r.valid for r in result.citations.collect()} == {True}
    assert [r.id for r in result.hits.where("query_id = 1").orderBy("rank").collect()][-1] == "deep"

    bodies = {r.query_id: json.loads(r.body) for r in answers_as_json(result).collect()}
    assert bodies[1]["success"] and len(bodies[1]["answer"]["citations"]) == 9
    assert bodies[2]["answer"]["citations"] == [] and bodies[2]["answer"]["lowConfidence"]
    given = bodies[1]["answer"]["retrievedChunks"]
    assert [c["chunk"]["id"] for c in given][-1] == "deep" and len(given) == 9
    assert given[0]["source"] == "hybrid" and given[0]["score"] > 0 and given[0]["semanticRank"] and given[0]["bm25Rank"]
    assert given[-1]["source"] == "bm25" and given[-1]["score"] > 0 and given[-1]["semanticRank"] is None
    assert bodies[2]["answer"]["retrievedChunks"] == []

    still = answer_questions(questions, chunks, index, HoppingModel(), generation=GenerationOptions(allow_multi_hop=False))
    assert not any(r.multi_hop for r in still.answers.collect())


def test_chat_model_falls_back(spark):
    def send(model, system_prompt, user_prompt, temperature, max_tokens):
        if model == "big":
            raise ServiceError("429", limited=True)
        return f"{user_prompt}/{temperature}/{max_tokens}"

    prompts = spark.createDataFrame([(1, "s", "u")], "query_id bigint, system_prompt string, user_prompt string")
    model = ChatModel(send, model="big", fallback="small", first_delay=0.0)
    row = model.answer(prompts).first()
    assert (row.text, row.model) == ("u/0.1/1024", "small")
    told = model.answer(prompts, GenerationOptions(model="other", temperature=0.7, max_tokens=9)).first()
    assert (told.text, told.model) == ("u/0.7/9", "other")
    named = spark.createDataFrame([("q", "s", "u")], "query_id string, system_prompt string, user_prompt string")
    assert model.answer(named).first().query_id == "q"
    calls = []

    def broken(*args):
        calls.append(args[0])
        raise ServiceError("500")

    with pytest.raises(ServiceError):
        ChatModel(broken, model="big", first_delay=0.0).call("s", "u")
    assert calls == ["big"] * 3
