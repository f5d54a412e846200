import sys

import pytest
from pyspark import cloudpickle

from docspark.engine import Engine, RequestError
from docspark.functions.words import NOT_FOUND
from docspark.operators.phrasing import PhrasingError
from docspark.sources import files as sources

WARFARE = "Electronic warfare is the use of the electromagnetic spectrum to attack an enemy or impede enemy operations. The three main subdivisions of electronic warfare are electronic attack, electronic protection and electronic support. Radar jamming is a form of electronic attack that disrupts the radar receivers of an enemy. Jamming is used because it blinds radar receivers during an attack. "
DRONES = "An unmanned aerial vehicle is an aircraft without a human pilot on board. Operators control the unmanned aircraft from a ground station by radio links. Surveys say that 42 percent of unmanned aircraft missions are flown at night. "


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Client:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, system, messages):
        if isinstance(self.reply, Exception):
            raise self.reply
        assert messages[-1]["role"] == "user" and "QUESTION:" in messages[-1]["content"]
        return self.reply


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = Engine(spark, f"file://{tmp_path_factory.mktemp('library')}")
    files = [("a.txt", WARFARE.encode()), ("b.md", DRONES.encode()), ("c.txt", WARFARE.encode()), ("d.exe", b"x"), ("e.txt", b""), ("f.txt", b"short"), ("g.pdf", b"no pdf")]
    got = out.ingest(spark.createDataFrame(files, "name string, content binary")).collect()
    assert [(r.name, r.duplicate, r.error) for r in got] == [("a.txt", False, None), ("b.md", False, None), ("c.txt", True, None), ("d.exe", False, sources.UNSUPPORTED), ("e.txt", False, sources.EMPTY), ("f.txt", False, sources.UNREADABLE), ("g.pdf", False, sources.CORRUPT)]
    return out


def test_library(engine, spark):
    again = engine.ingest(spark.createDataFrame([("z.txt", WARFARE.encode())], "name string, content binary"), mode="openai").collect()
    assert again[0].duplicate and again[0].doc_id == 1
    assert [r.name for r in engine.list_documents().collect()] == ["a.txt", "b.md"] and engine.system()["documents"] == 2
    doc = engine.document(1)
    assert doc["summary"].startswith("• ") and doc["summary"].endswith("(p.1)") and "electronic" in doc["keywords"]
    assert engine.page_text(1, 1) == WARFARE.strip()
    for call in (lambda: engine.document(99), lambda: engine.page_text(1, 9), lambda: engine.ask("x", scope=99), lambda: engine.delete_document(99)):
        with pytest.raises(RequestError) as error:
            call()
        assert error.value.code == 404


def test_grounded_answers_and_refusals(engine):
    got = engine.ask("What are the three main subdivisions of electronic warfare?")
    assert got["status"] == "grounded" and "subdivisions" in got["answer"] and got["sources"][0]["cited"] and got["sources"][0]["highlights"]
    assert got["tech"]["gate"]["tier"] == "high" and got["mode"] == "extractive"
    for question in ("Who won the 2018 FIFA World Cup?", "Explain how to bake sourdough bread", "What percentage of radar jamming is used?"):
        refused = engine.ask(question)
        assert (refused["status"], refused["answer"]) == ("not_found", NOT_FOUND)
    assert engine.ask("What percentage of unmanned aircraft missions are flown at night?")["status"] == "grounded"
    summary = engine.ask("Summarise the key points of this document", scope=2)
    assert summary["answer"] == engine.document(2)["summary"]
    assert "a.txt\n" in engine.ask("tl;dr")["answer"]


def test_history_and_follow_up(engine):
    engine.clear_history(1)
    first = engine.ask("What is radar jamming?", scope=1)
    second = engine.ask("Why is it used?", scope=1)
    assert second["status"] in ("grounded", "low_confidence") and set(first["tech"]["query_terms"]) <= set(second["tech"]["query_terms"])
    assert [r.role for r in engine.history(1).collect()] == ["user", "assistant"] * 2
    engine.clear_history(1)
    assert engine.history(1).count() == 0


def test_validation_and_modes(engine, spark, tmp_path):
    empty = Engine(spark, f"file://{tmp_path}")
    for make, code in ((lambda: empty.ask("x"), 409), (lambda: engine.ask(" "), 400), (lambda: engine.ask("x" * 1001), 400), (lambda: engine.ask("x", mode="openai"), 409), (lambda: engine.ask("x", mode="other"), 400)):
        with pytest.raises(RequestError) as error:
            make()
        assert error.value.code == code


def test_model_replies(engine):
    question = "What are the main subdivisions of electronic warfare?"
    for reply, status, mode in (("Three of them [P1][P1].", "grounded", "openai"), ("not_in_document ", "not_found", "openai"), (PhrasingError("The model refused the key."), "grounded", "extractive"), (" ", "grounded", "extractive")):
        engine.clients = {"openai": Client(reply)}
        got = engine.ask(question)
        assert (got["status"], got["mode"], got["tech"]["llm_called"]) == (status, mode, True)
        assert (got["note"] is None) == (mode == "openai")
    engine.clients = {}


def test_model_summaries(engine, spark):
    for reply, mode in (("A summary.", "openai"), (PhrasingError("no"), "extractive")):
        engine.clients = {"openai": Client(reply)}
        got = engine.ingest(spark.createDataFrame([("m.txt", (mode + WARFARE).encode())], "name string, content binary"), mode="openai").first()
        doc = engine.document(got.doc_id)
        assert doc["summary_mode"] == mode and (doc["summary"] == "A summary.") == (mode == "openai")
        engine.delete_document(got.doc_id)
    engine.clients = {}
    assert engine.store.next_id("documents") == 5  # ids of deleted documents aren't given again


def test_delete(engine, spark):
    engine.ask("What is radar jamming?", scope=1)
    engine.delete_document(1)
    assert [r.doc_id for r in engine.list_documents().collect()] == [2]
    assert engine.store.read("chunks").where("doc_id = 1").count() == engine.store.read("messages").where("scope = '1'").count() == 0
    assert engine.ingest(spark.createDataFrame([("n.txt", WARFARE.encode())], "name string, content binary")).first().doc_id == 5
