"""Made-up command output, a few lines for each tool, with what becomes of each line worked out by hand.

The first character of a line says it: "!" critical, "." stays, "-" goes at the balanced level, "~"
goes at the aggressive level, "+" is written at the aggressive level only, "=" at both levels.
"""

from __future__ import annotations

SAMPLES = {
    "alembic": "-INFO  [alembic.runtime.migration] Context impl PostgresqlImpl.\n-INFO  [alembic.runtime.migration] Will assume transactional DDL.\n!INFO  [alembic.runtime.migration] Running upgrade 1a2b -> 3c4d, add users\n!FAILED: target database is not up to date\n.see the log",
    "ansible-playbook": ".PLAY [web] ****\n~TASK [facts] ****\n-ok: [h1]\n-\n.TASK [copy] ****\n~changed: [h1]\n!fatal: [h2]: FAILED! => no space\n~TASK [late] ****\n-skipping: [h1]\n!PLAY RECAP ****\n.h1 : ok=3 changed=1 unreachable=0 failed=0\n!h2 : ok=1 changed=0 unreachable=0 failed=1",
    "apt-get": "-Reading package lists...\n!The following NEW packages will be installed:\n~  libalpha libbeta libgamma\n~  libdelta libepsilon\n+  (+5 packages)\n!0 upgraded, 5 newly installed, 0 to remove and 2 not upgraded.\n-Get:1 http://a.example stable/main x\n-Setting up libalpha (1.0)\n~W: a key is old\n!E: Could not get lock",
    "aws": "-------------------\n.InstanceId   State\n-+----+----+\n.i-0a1b       up\n-Waiting for instance\n-...\n!An error occurred (AccessDenied)",
    "az": ".Name    resourceGroup\n-------  -------------\n.one     prod\n-\n!ERROR: the group does not exist",
    "bazel": "-Loading: 0 packages loaded\n-[3 / 40] building //a:b; 2s\n-INFO: Analyzed 3 targets\n.INFO: Build completed, 1 test FAILED, 9 actions\n-Target //a:b up-to-date:\n-  bazel-bin/a/b\n-//a:ok_test   PASSED in 0.3s\n!//a:bad_test  FAILED in 1.1s\n~//a:skipped_test_with_a_rather_long_name  NO STATUS\n~//a:other_test_with_a_rather_long_name  NO STATUS\n!Executed 2 out of 4 tests: 1 fails.\n+(+2 build targets, run `bazel build` for the list)",
    "biome": "-Checking 12 files\n!src/a.ts:3:5 lint/style/useConst  FIXABLE\n!  ✖ This let is never reassigned.\n-    3 | let a = 1;\n-      ^^^^\n.Checked 12 files in 30ms.\n!Found 1 error.",
    "brew": "-==> Downloading https://a.example/x.tar.gz\n-==> Fetching dependencies for x: y\n!==> Pouring x--1.0.bottle.tar.gz\n~Warning: y 2.0 is already installed\n.==> Caveats\n!🍺  /opt/homebrew/Cellar/x/1.0: 12 files\n!Error: no such formula",
    "bundle": "-Using rails 7.1.0\n-Fetching nokogiri 1.16.0\n-Installing nokogiri 1.16.0\n.Post-install message from x:\n!Bundle complete! 3 Gemfile dependencies\n!Could not find gem 'y'",
    "cargo": "-   Compiling foo v0.1.0\n~warning: unused variable: `x`\n!error[E0308]: mismatched types\n. --> src/main.rs:3:5\n-    Finished dev in 1s\n!test result: FAILED. 1 passed; 1 failed\n!thread 'main' panicked at src/a.rs:1",
    "cmake": "--- The C compiler identification is GNU\n.Scanning dependencies of target a\n-[ 50%] Building CXX object a.o\n~a.cpp:3: warning: unused\n!a.cpp:4: error: no member\n!CMake Error at CMakeLists.txt:5\n!gmake[1]: *** [a.o] Error 1",
    "composer": "-Loading composer repositories with package information\n.Lock file operations: 2 installs\n-  - Installing symfony/console (v6.0)\n-  - Downloading psr/log (1.0)\n-\n!  Problem 1\n!    - x could not be resolved\n.Generating autoload files",
    "curl": "-*   Trying 10.0.0.1:443...\n.* Connected to a.example (10.0.0.1)\n-* TLSv1.3 (OUT), TLS handshake\n-> GET / HTTP/2\n!< HTTP/2 200\n~< content-type: text/html\n-\n.hello body\n!curl: (6) Could not resolve host",
    "yum": "-Last metadata expiration check: 0:01 ago\n.Dependencies resolved.\n.Installing:\n~ libfoo   x86_64  1.0-1.el8  baseos  120 k\n~ libbar   noarch  2.0-1.el8  baseos  20 k\n+  (+2 packages)\n!Transaction Summary\n!Install  2 Packages\n-(1/2): libfoo-1.0.rpm  120 kB/s | 120 kB\n-  Installing : libfoo-1.0.x86_64   1/2\n!Installed:\n!  libfoo.x86_64 1.0-1.el8\n!Complete!",
    "docker": ".Step 1/4 : FROM alpine\n-a1b2c3d4e5f6: Pulling fs layer\n-0011aabbccdd: [=====>   ] 1.2MB/5MB\n-===> x: Extracting\n~Step 2/4 : RUN apk add x\n----> Using cache\n. ---> 0f1e2d3c\n~Step 3/4 : COPY . .\n!Successfully built 0f1e2d3c\n!ERROR: failed to solve: no such file\n+  (+2 build steps)",
    "dotnet": "-  Determining projects to restore...\n-  Restored /a/b.csproj\n~a.cs(3,4): warning CS0168: unused\n!a.cs(5,6): error CS0103: no name\n!Build FAILED.\n.    1 Warning(s)\n!    1 Error(s)",
    "eslint": "./src/clean.js is fine\n-/src/warned.js\n-  1:1  warning  unexpected console  no-console\n-\n./src/bad.ts\n!  2:5  error  x is not defined  no-undef\n-  3:1  warning  too long  max-len\n!✖ 3 problems (1 error, 2 warnings)",
    "flyway": "-Flyway Community Edition 9.0 by Redgate\n-Database: jdbc:postgresql://h/db\n-Successfully validated 3 migrations\n-Current version of schema: 1\n!Migrating schema to version 2 - add\n!Successfully applied 1 migration\n!ERROR: migration of 3 failed",
    "gcloud": ".NAME  PROJECT_ID\n-Waiting for operation to finish\n-....\n.a     p-1\n!ERROR: (gcloud.x) permission denied",
    "gem": "-Fetching rack-2.2.gem\n-Building native extensions. This could take a while...\n!Successfully installed rack-2.2\n-Parsing documentation for rack-2.2\n.see the changes\n!1 gem could not be built\n!2 gems installed",
    "gh": "-Showing 5 of 20 runs\n.STATUS\tTITLE\tWORKFLOW\n~completed\tsuccess\tfix the docs\tci\n~completed\tsuccess\tadd a test\tci\n+  (+2 successful)\n!completed\tfailure\tbreak it\tci\n~completed\tsuccess\tmend the thing again\tci\n+  (+1 successful)",
    "git": '-On branch main\n-Your branch is up to date with \'origin/main\'.\n-\n!Changes not staged for commit:\n-  (use "git add <file>..." to update)\n!\tmodified:   a.py\n-\n!Untracked files:\n-  (use "git add <file>..." to include)\n~\tnotes/one_long_file_name_here.txt\n~\tnotes/two_long_file_name_here.txt\n-\n-no changes added to commit\n+  (+2 untracked files, run `git status` for the list)',
    "golangci-lint": "!a/b.go:12:3: unused variable (unused)\n-\tx := 1\n-\t^\n!2 issues:\n-* unused: 2\n.done",
    "go": "-=== RUN   TestA\n---- PASS: TestA (0.00s)\n!--- FAIL: TestB (0.01s)\n!    b_test.go:12: want 1\n!FAIL\n~ok  \tmod/a\t0.01s\n~ok  \tmod/b\t0.02s\n.?   \tmod/c\t[no test files]\n+ok\t(+2 passing packages)",
    "gradle": "-Starting a Gradle Daemon\n-> Task :compileJava\n-<=====------> 40%\n!> Task :test FAILED\n!FAILURE: Build failed with an exception.\n.3 tests completed, 1 failed\n!* What went wrong:\n!BUILD FAILED in 3s",
    "helm": ".NAME: web\n~LAST DEPLOYED: Mon\n~NAMESPACE: prod\n!STATUS: deployed\n.REVISION: 3\n-NOTES:\n-Visit http://a.example\n-\n-and log in\n!Error: the upgrade stopped",
    "jest": "-PASS src/a.test.js\n!FAIL src/b.test.js\n!  ● adds\n.    at line 3\n!    Expected: 2\n!    Received: 3\n-  console.log hello\n!Tests: 1 failed, 3 passed",
    "kubectl": "!NAME    READY   STATUS    AGE\n~web-1   1/1     Running   3d\n~web-2   1/1     Running   3d\n+  (+2 healthy rows)\n!web-3   0/1     CrashLoopBackOff   1h\n~web-4   1/1     Running   3d and some more\n+  (+1 healthy rows)",
    "oc": ".Name:         web-1\n.Namespace:    prod\n-Labels:       app=web\n-              tier=front\n-Annotations:  a=b\n.Events:\n-  Normal   Pulled  3m  kubelet  ok\n!  Warning  BackOff 1m  kubelet  restarting",
    "make": "-make[1]: Entering directory '/a'\n-gcc -O2 -c a.c -o a.o\n~a.c:3: warning: unused\n!a.c:4: error: expected ';'\n.building a\n!make: *** [a.o] Error 1\n!ld: symbol missing",
    "mix": "-==> app\n-Compiling 3 files (.ex)\n~warning: unused variable\n~  lib/a.ex:3: A.b/1\n!** (CompileError) lib/a.ex:4\n.  1 doctest\n!  1) test adds (ATest)\n!2 tests, 1 failure",
    "mvn": "-[INFO] Scanning for projects...\n-Downloading from central: https://a.example/x.pom\n~[WARNING] deprecated\n!Tests run: 3, Failures: 1\n.some text\n!BUILD FAILURE\n![ERROR] no such goal",
    "ninja": "-[1/3] Compiling a.c\n~a.c:3: warning: unused\n!FAILED: a.o\n!a.c:4: error: no\n.1 error generated.\n!ninja: build stopped: subcommand failed.",
    "nix": "!these 2 derivations will be built:\n-  /nix/store/aa-x.drv\n-  /nix/store/bb-y.drv\n-building '/nix/store/aa-x.drv'...\n-copying path '/nix/store/cc' from 'https://a.example'\n~x> checking for gcc\n.x> Error 2 seen\n!error: builder for x did not end well",
    "nomad": ".ID            = web\n!Status        = running\n.Allocations\n!ID        Node ID   Task Group  Status\n~0a1b2c3d  4e5f6a7b  web  running\n~1a1b2c3d  4e5f6a7b  web  complete\n+  (+2 healthy allocations)\n!2a1b2c3d  4e5f6a7b  web  failed\n-Recent Events:\n-Time  Type\n-3m    Started\n-\n.end",
    "npm": "-npm http fetch GET 200 https://a.example/x\n-npm warn deprecated inflight@1.0.6: leaks memory\n-npm warn deprecated glob@7.2.3: use v9\n-⠙\n!added 30 packages in 2s\n.run `npm fund` for details\n!2 vulnerabilities\n!npm error code E404\n=  (+2 deprecation warnings)",
    "packer": "-==> amazon-ebs: Creating temporary keypair\n-    amazon-ebs: Found image\n~==> Wait completed after 3 minutes and some\n~==> Wait completed after 4 minutes and some\n+  (+2 build steps)\n!Build 'amazon-ebs' finished after 4 minutes.\n!==> Builds finished.\n.bye",
    "pip3": "-Collecting requests\n-  Downloading requests-2.0.whl (60 kB)\n-Requirement already satisfied: idna\n~WARNING: You are using pip version 20; however, version 24 is available.\n!ERROR: Could not find a version that satisfies x\n.Looking in indexes\n!Successfully installed requests-2.0",
    "playwright": "-Running 3 tests using 2 workers\n-  ✓  1 a.spec.ts:3 adds (1s)\n!  ✘  2 a.spec.ts:9 subtracts (2s)\n!    Error: expect(received).toBe(expected)\n.    at a.spec.ts:12\n!  1 failed",
    "prettier": "-Checking formatting...\n![warn] src/a.js\n![error] src/b.js: SyntaxError\n.done in 1s\n-\n![warn] Code style issues found in 1 file.",
    "pulumi": "~Previewing update (dev)\n~View Live: none\n!+ aws:s3:Bucket b create\n-      name: x\n.    ~ tags\n-Diagnostics:\n!Resources:\n!    + 1 to create\n!error: preview did not pass",
    "pytest": ".===== test session starts =====\n-platform linux -- Python 3.13\n-rootdir: /a\n-collected 5 items\n~tests/test_alpha.py ...          [ 60%]\n~tests/test_beta.py ..            [ 90%]\n.tests/test_gamma.py F            [100%]\n!===== FAILURES =====\n!E   x is 2\n!FAILED tests/test_gamma.py::test_x\n!1 failed, 5 passed\n+  (+2 passing test files)",
    "rspec": "-Run options: include\n-Randomized with seed 3\n-.....\n!Failures:\n!  1) Adder adds\n!     Failure/Error: expect(1).to eq 2\n!       expected: 2\n!            got: 1\n-Finished in 0.1 seconds\n!5 examples, 1 failure",
    "rubocop": "-Inspecting 3 files\n-.C.\n.Offences by file\n!a.rb:3:5: C: Style/X: no\n-    foo = 1\n-    ^^^\n-\n!3 files inspected, 1 offense detected",
    "ruff": "!a.py:3:5: F401 unused import\n-  3 | import os\n-    ^^^ F401\n!Found 1 error.\n-[*] 1 fixable with the `--fix` option.\n.ok",
    "sbt": "-[info] compiling 3 sources\n~[warn] deprecated\n![error] a.scala:3: no\n.Total time: 3 s\n![success] done",
    "swift": "-[1/3] Compiling A a.swift\n~a.swift:3:5: warning: unused\n!a.swift:4:5: error: no\n-Test Suite 'A' started at 1\n-Test Case 'A.b' passed (0.1 s)\n!Test Case 'A.c' failed (0.1 s)\n!Executed 2 tests, with 1 other\n.bye\n!Build complete! (1s)",
    "terraform": "-Initializing the backend...\n-aws_x.a: Refreshing state... [id=1]\n~Terraform will perform the following actions:\n!  # aws_x.a will be created\n!  + resource \"aws_x\" \"a\" {\n.      + name = \"n\"\n-      + id   = (known after apply)\n-        size = 3\n~    }\n-\n!Plan: 1 to add, 0 to change, 0 to destroy.",
    "tsc": "!a.ts(3,5): error TS2304: Cannot find name 'x'.\n-Files:              300\n-Check time:        1.0s\n.Version 5\n!Found 1 error in a.ts:3",
    "uv": "!Resolved 3 packages in 10ms\n-Downloaded x\n-Prepared 1 package in 2ms\n!Installed 1 package in 1ms\n- + x==1.0\n.note\n!error: no such thing",
    "vitest": "-✓ src/a.test.ts (3 tests)\n!❯ src/b.test.ts (1 test)\n!  × adds\n!AssertionError: no\n.  at line 3\n!Test Files  1 failed | 1 passed",
    "pnpm": "-Packages: +3\n-Progress: resolved 3, reused 3\n-+ x 1.0.0\n-warning old x\n.Done in 1s\n! ERR_PNPM_NO_MATCH no version",
    "unknown": "..\x1b[1mbold\x1b[0m and\n.the rest",
}


def outputs() -> list[tuple[str, str]]:
    """(command, raw text) of each sample."""
    return [(c, "\n".join(x[1:] for x in s.split("\n") if x[0] not in "+=")) for c, s in SAMPLES.items()]


def expected(command: str, level: str) -> str:
    """What is left of a sample at a level, by its marks."""
    out = {"balanced": "!.~=", "aggressive": "!.+="}[level]
    lines = [x for x in SAMPLES[command].split("\n") if x[0] in out]
    return "\n".join(x[1:] for x in lines).strip("\n").replace("\x1b[1m", "").replace("\x1b[0m", "")


#: Where a sample takes its names and counts from a row: {w} a word, {k} a count, {k1} and {k2} one more and twice as many; a line with {i} comes k times, i from 1.
SLOTS = {
    "alembic": [("users", "{w}s")],
    "ansible-playbook": [("-ok: [h1]", "-ok: [{w}{i}]"), ("~changed: [h1]", "~changed: [{w}{i}]"), ("no space", "no space on {w}")],
    "apt-get": [("~  libalpha libbeta libgamma\n~  libdelta libepsilon", "~  lib{w}{i}a lib{w}{i}b"), ("+5 packages", "+{k2} packages"), ("5 newly", "{k2} newly")],
    "aws": [("i-0a1b", "i-{w}{i}")],
    "az": [(".one", ".{w}{i}")],
    "bazel": [("~//a:skipped_test_with_a_rather_long_name  NO STATUS\n~//a:other_test_", "~//a:{w}_{i}_"), ("(+2", "(+{k}")],
    "biome": [("src/a.ts:3:5", "src/{w}.ts:{k}:5")],
    "brew": [("for x: y", "for {w}{i}: y"), ("Pouring x", "Pouring {w}")],
    "bundle": [("Using rails", "Using {w}{i}")],
    "cargo": [("foo v0.1.0", "{w}{i} v0.1.0"), ("`x`", "`{w}`")],
    "cmake": [("object a.o", "object {w}{i}.o")],
    "composer": [("symfony/console", "{w}/{w}{i}")],
    "curl": [("to a.example", "to {w}.example"), ("content-type", "x-{w}-{i}")],
    "yum": [("~ libfoo   x86_64  1.0-1.el8  baseos  120 k\n~ libbar   noarch  2.0", "~ lib{w}{i}   noarch  2.0"), ("+2 packages", "+{k} packages")],
    "docker": [("apk add x", "apk add {w}{i}"), ("+2 build", "+{k1} build")],
    "dotnet": [("/a/b.csproj", "/a/{w}{i}.csproj"), ("CS0168: ", "CS0168: {w} ")],
    "eslint": [("1:1  warning  unexpected console", "{i}:1  warning  unexpected {w}")],
    "flyway": [("version 2 - add", "version {k} - add {w}")],
    "gcloud": [(".a     p-1", ".{w}{i}     p-1")],
    "gem": [("rack", "{w}")],
    "gh": [("~completed\tsuccess\tfix the docs\tci\n~completed\tsuccess\tadd a test", "~completed\tsuccess\tfix {w} {i}"), ("+2 successful", "+{k} successful")],
    "git": [("~\tnotes/one_long_file_name_here.txt\n~\tnotes/two_long_file_name_here", "~\tnotes/{w}_long_file_name_{i}"), ("+2 untracked", "+{k} untracked")],
    "golangci-lint": [("variable", "variable {w}")],
    "go": [("~ok  \tmod/a\t0.01s\n~ok  \tmod/b", "~ok  \tmod/{w}{i}"), ("+2 passing", "+{k} passing")],
    "gradle": [(":compileJava", ":{w}{i}")],
    "helm": [(".NAME: web", ".NAME: {w}")],
    "jest": [("src/a.test", "src/{w}{i}.test")],
    "kubectl": [("~web-1   1/1     Running   3d\n~web-2", "~{w}-{i}"), ("+2 healthy", "+{k} healthy")],
    "oc": [("web-1", "{w}-1")],
    "make": [("-c a.c", "-c {w}{i}.c")],
    "mix": [("app", "{w}")],
    "mvn": [("projects", "{w}{i}")],
    "ninja": [("[1/3] Compiling a.c", "[{i}/{k}] Compiling {w}.c")],
    "nix": [("-  /nix/store/aa-x", "-  /nix/store/aa-{w}{i}")],
    "nomad": [("~0a1b2c3d  4e5f6a7b  web  running\n~1a1b2c3d  4e5f6a7b  web", "~{i}a1b2c3d  4e5f6a7b  {w}"), ("+2 healthy", "+{k} healthy")],
    "npm": [("-npm warn deprecated inflight@1.0.6: leaks memory\n-npm warn deprecated glob", "-npm warn deprecated {w}{i}"), ("+2 deprecation", "+{k} deprecation")],
    "packer": [("~==> Wait completed after 3 minutes and some\n~==> Wait completed after 4", "~==> Wait for {w} completed after {i}"), ("+2 build", "+{k} build")],
    "pip3": [("Collecting requests", "Collecting {w}{i}")],
    "playwright": [("✓  1 a.spec", "✓  {i} {w}.spec")],
    "prettier": [("src/a.js", "src/{w}.js")],
    "pulumi": [("name: x", "name: {w}")],
    "pytest": [("~tests/test_alpha.py ...          [ 60%]\n~tests/test_beta", "~tests/test_{w}{i}"), ("+2 passing", "+{k} passing")],
    "rspec": [("Adder", "{w}")],
    "rubocop": [("a.rb:3", "{w}.rb:{k}")],
    "ruff": [("a.py:3", "{w}.py:{k}")],
    "sbt": [("3 sources", "{k} sources of {w}")],
    "swift": [("[1/3] Compiling A", "[{i}/{k}] Compiling {w}")],
    "terraform": [("aws_x.a:", "aws_x.{w}{i}:")],
    "tsc": [("'x'", "'{w}'")],
    "uv": [("+ x==", "+ {w}{i}==")],
    "vitest": [("src/a.test", "src/{w}{i}.test")],
    "pnpm": [("-+ x ", "-+ {w}{i} ")],
    "unknown": [("rest", "rest of {w}")],
}


def templates() -> list[tuple[str, int, str, str]]:
    """(command, nr, mark, line with slots) of each line of the samples."""
    out = []
    for command, sample in SAMPLES.items():
        for old, new in SLOTS[command]:
            if old not in sample:
                raise ValueError(f"{command}: {old!r} isn't in its sample")
            sample = sample.replace(old, new)
        out += [(command, nr, x[0], x[1:]) for nr, x in enumerate(sample.split("\n"))]
    return out


def filled(command: str, marks: str, w: str, k: int) -> str:
    """The lines of a sample with one of the marks, its slots filled."""
    lines = []
    for c, _, mark, line in templates():
        if c == command and mark in marks:
            line = line.replace("{w}", w).replace("{k}", str(k)).replace("{k1}", str(k + 1)).replace("{k2}", str(2 * k))
            lines += [line.replace("{i}", str(i)) for i in range(1, k + 1)] if "{i}" in line else [line]
    return "\n".join(lines)


#: Samples that sniffing takes for what they are, or reduces in the same way.
SNIFFED = [c for c in SAMPLES if c not in ("biome", "brew", "mix", "packer", "unknown")]
