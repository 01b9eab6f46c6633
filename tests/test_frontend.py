from tarnwood.frontend.python_flows import facts, findings
from tarnwood.functions.findings import BIT

FILES = {
    "a.py": "import os\n\ndef run(cmd):\n    os.system(cmd)\n\ndef safe(x):\n    return shlex.quote(x)\n",
    "b.py": "from a import run, safe\n\ndef handler():\n    c = request.args.get('c')\n    run(c)\n    run(safe2(c))\n\ndef deep():\n    q = input()\n    middle(q)\n\ndef middle(z):\n    run('ls ' + z)\n",
    "c.py": "def view():\n    uid = request.form['id']\n    if uid:\n        sql = f'select {uid}'\n    else:\n        sql = 'select 1'\n    cursor.execute(sql)\n    cursor.execute('select ?', uid)\n    n = int(uid)\n    eval(n)\n    subprocess.run(['ls', uid])\n    config.cmd = os.getenv('X')\n    os.popen(config.cmd)\n    a, b = 1, uid\n    eval(a)\n    exec(b)\n",
    "broken.py": "def (:\n",
}


def test_flows_within_and_across_files(spark):
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
    got = {(r.path, r.line, r.cap, r.hops) for r in findings(df).collect()}
    assert {("c.py", 7, BIT["SQL_QUERY"], 0), ("c.py", 13, BIT["CODE_EXEC"], 0), ("c.py", 16, BIT["CODE_EXEC"], 0), ("b.py", 5, BIT["CODE_EXEC"], 1), ("b.py", 10, BIT["CODE_EXEC"], 2)} <= got
    assert not {x for x in got if x[0] == "c.py" and x[1] in (8, 10, 11, 15)}
    status = {r.path: r.status for r in facts(df).where("kind = 'file'").collect()}
    assert status == {"broken.py": "SyntaxError"}
