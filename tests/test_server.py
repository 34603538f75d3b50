import io
import json

from quarry.__main__ import parser
from quarry.plans.server import serve


class Fake:
    def search_code(self, **a):
        return {"results": [a["query"]]}

    def index_codebase(self, path, **a):
        raise RuntimeError("disk full")


def test_messages():
    calls = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search_code", "arguments": {"query": "q", "path": "."}}},
        {"id": 4, "method": "tools/call", "params": {"name": "index_codebase", "arguments": {"path": "."}}}, {"id": 5, "method": "tools/call", "params": {"name": "x"}}, {"id": 6, "method": "ping"},
    ]
    out = io.StringIO()
    serve(Fake(), io.StringIO("\n".join(map(json.dumps, calls)) + "\nnot json\n"), out)
    r = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in r] == [1, 2, 3, 4, 5, 6, None]
    assert len(r[1]["result"]["tools"]) == 3 and json.loads(r[2]["result"]["content"][0]["text"]) == {"results": ["q"]}
    assert r[3]["result"]["isError"] and "disk full" in r[3]["result"]["content"][0]["text"] and r[4]["error"]["code"] == -32601


def test_arguments():
    a = parser().parse_args(["search", ".", "login", "--top-k", "3"])
    assert (a.command, a.query, a.top_k) == ("search", "login", 3)
