import json
import random

from tallyreel.llm import toolcalls

COLUMNS = (
    "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, status string"
)


def arguments(refers):
    return json.dumps({"query": "q", "after": [{"$ref": r} for r in refers]})


def plain_places(calls, results):
    """Place of every call by following all references; None for calls whose references lead to a cycle."""
    found, walking = {}, set()

    def place(name):
        if name in walking:
            return None
        if name not in found:
            walking.add(name)
            turn, refers = calls[name]
            own = (turn, 0)
            for other in refers:
                if other not in calls or other not in results:
                    continue
                before = place(other)
                if before is None:
                    own = None
                    break
                at, depth = before
                result = (at, depth + 1) if at >= results[other] else (results[other], 0)
                own = max(own, (result[0], result[1] + 1))
            walking.discard(name)
            if own is None:
                return None
            found[name] = own
        return found[name]

    return {name: place(name) for name in calls}


def test_places_are_those_of_following_every_reference(spark):
    chance = random.Random(4)
    rows, wanted = [], {}
    for conv in range(60):
        n = chance.randrange(1, 12)
        names = [f"{conv}.{i}" for i in range(n)]
        turns = [chance.randrange(20) for _ in names]
        calls = {}
        for i, name in enumerate(names):
            # Conversations of even number refer one way only, so they have no cycles.
            among = [o for j, o in enumerate(names) if conv % 2 or j > i] + [f"{conv}.gone"]
            calls[name] = (turns[i], sorted(set(chance.choices(among, k=chance.randrange(4)))))
        answered = {name: chance.randrange(20) for name in names if chance.random() < 0.8}
        for name, (turn, refers) in calls.items():
            rows.append((conv, turn, "assistant", "t", name, "search", arguments(refers), "x"))
        rows += [(conv, turn, "tool", "r", name, None, None, "x") for name, turn in answered.items()]
        for name, at in plain_places(calls, answered).items():
            wanted[name] = (*(at or (calls[name][0], 0)), at is None)
    found = toolcalls.format_messages(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(found) == len(rows)
    assert {r["call_id"]: (r["at"], r["depth"], r["status"] == "cycle") for r in found if r["is_call"]} == wanted
    assert sum(cyclic for *_, cyclic in wanted.values()) > 20
    assert max(depth for _, depth, _ in wanted.values()) > 4


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of a thousand calls, each before the one it refers to; a cycle of as many; a hub all refer to."""
    rounds, jump = [], toolcalls._jump
    monkeypatch.setattr(toolcalls, "_jump", lambda states: rounds.append(1) or jump(states))
    n, rows = 1000, []
    for i in range(n):
        for conv, refers in ((1, f"1.{i + 1}"), (2, f"2.{(i + 1) % n}"), (3, f"3.{n - 1}")):
            wanted = [] if conv == 3 and i == n - 1 else [refers]
            rows.append((conv, 2 * i, "assistant", None, f"{conv}.{i}", "search", arguments(wanted), "x"))
            rows.append((conv, 2 * i + 1, "tool", None, f"{conv}.{i}", None, None, "x"))
    found = toolcalls.format_messages(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()
    assert len(rounds) <= 12
    calls = {r["call_id"]: r for r in found if r["is_call"]}
    for i in range(n - 1):
        # The chain's last call has its result one turn later; each call before it comes after the next one's result.
        assert (calls[f"1.{i}"]["at"], calls[f"1.{i}"]["depth"]) == (2 * n - 1, 2 * (n - 2 - i) + 1)
        assert (calls[f"3.{i}"]["at"], calls[f"3.{i}"]["depth"]) == (2 * n - 1, 1)
    assert all(calls[f"2.{i}"]["status"] == "cycle" and calls[f"2.{i}"]["at"] == 2 * i for i in range(n))


def test_nulls_very_long_arguments_and_repeated_rows(spark):
    long = json.dumps({"query": "w " * 400_000, "after": {"$ref": "b"}})
    first = (1, 0, "assistant", None, "a", "search", long, None)
    rows = [
        first,
        first,
        (1, None, "assistant", None, "b", None, None, None),
        (1, None, "tool", None, "b", None, None, None),
        (1, 3, "tool", "", "b", None, None, None),
        (None, None, None, None, None, None, None, None),
        (None, 1, "assistant", None, "a", "search", "{}", None),
    ]
    found = toolcalls.format_messages(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(found) == len(rows)
    assert [(r["at"], r["depth"], len(r["message"]) > 800_000) for r in found if r["call_id"] == "a" and r["conv_id"]] == [
        (3, 1, True)
    ] * 2
    assert sorted(r["status"] for r in found) == [
        "answered", "linked", "linked", "plain", "unanswered", "unanswered", "unanswered",
    ]
