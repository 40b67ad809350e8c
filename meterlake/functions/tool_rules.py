"""What the reducers of command output know about each tool: plain data, one entry for each command.

Patterns are searched in a line both without the space around it and with its indentation, `header`
only in the latter, `sniff` and `table` in the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Block:
    """Lines after one that fits `start`, as long as they fit `inside`: they go."""

    start: str
    inside: str = "."
    keep: bool = False  # the lines stay, whatever the other rules say, but for blank ones
    start_stays: bool = False
    before_critical: bool = False  # inside lines go even if they look critical
    past_critical: bool = False  # a critical line doesn't end the block


@dataclass(frozen=True)
class Count:
    """Lines that a count stands for, if it is shorter than they are."""

    lines: str
    summary: str  # {n}: how many
    balanced: bool = False  # already at the balanced level
    in_place: bool = False  # each run of such lines where it stands, else all at the end
    after: str = ""  # only lines after one that fits, up to the first that doesn't fit `lines`
    but_first: bool = False
    words: bool = False  # {n}: how many words
    always: bool = False  # even if it isn't shorter
    ended_by_dropped: bool = False


@dataclass(frozen=True)
class Tool:
    names: tuple[str, ...]  # the command, then its aliases
    sniff: str  # other texts are only scrubbed
    critical: str  # must survive at each level
    uncritical: str = ""  # isn't critical even so
    drop: str = ""  # goes at the balanced level
    keep: str = ""  # stays at the aggressive level
    more: str = ""  # goes at the aggressive level
    blanks: bool = False  # blank lines go at the balanced level
    json: bool = False  # JSON passes as it is
    blocks: tuple[Block, ...] = ()
    counts: tuple[Count, ...] = ()
    header: str = ""  # stays only if a line under it does
    header_lines: str = "."  # lines that count for this
    header_ends: str = "(?!)"  # lines up to which they count
    header_balanced: bool = False  # at the balanced level too
    table: str = ""  # texts that have it only have counts, others have none


# Shared patterns.
CLOUD = r"(?i)error|failed|denied|does not exist|not found|exception"
DECORATION = r"^(?=.*[+|-])[+| -]+$|^Waiting for|^Running|^\.+$"
ARCHES = "x86_64|noarch|aarch64|i686|ppc64le|s390x|src|armv7hl"
STATS = "Files|Lines|Nodes|Identifiers|Symbols|Types|Instantiations|Memory used|Assignability cache size|I/O Read|Parse time|Bind time|Check time|Emit time|Total time"
UNHEALTHY = "CrashLoopBackOff|ImagePullBackOff|ErrImagePull|OOMKilled|ContainerCreating|Terminating|Evicted|Pending|NotReady|Back-off|Failed|Error"

# The rules of each tool, by command.
TOOLS = [
    Tool(("alembic",), "alembic|Running upgrade|Running downgrade|runtime\\.migration|revision", r"Running upgrade|Running downgrade|Error|error|FAILED|Traceback|\.exc\.", drop="Context impl|Will assume transactional DDL"),
    Tool(
        ("ansible-playbook", "ansible"),
        r"PLAY \[|TASK \[|PLAY RECAP|ok:|changed:|ansible",
        r"^failed:|^fatal:|FAILED!|UNREACHABLE!|^PLAY RECAP|^(?!.*failed=0).*failed=|^(?!.*unreachable=0).*unreachable=",
        drop="^ok:|^skipping:",
        more="^changed:",
        blanks=True,
        blocks=(Block("^PLAY RECAP", ".*", keep=True, start_stays=True, past_critical=True),),
        header=r"^TASK \[",
        header_ends="^PLAY ",
    ),
    Tool(
        ("apt", "apt-get"),
        "Reading package lists|Get:|Fetched |Unpacking |Setting up |apt|Preparing to unpack|newly installed",
        "^E:|Err:|not upgraded|^The following packages will be REMOVED|^The following NEW packages will be installed",
        drop="^Get:|^Hit:|^Ign:|^Reading package lists|^Building dependency tree|^Reading state information|^Fetched |^Preparing to unpack|^Unpacking |^Setting up |^Processing triggers for|^Progress:",
        more="^W:",
        blanks=True,
        counts=(Count("^ +[^ ]", "  (+{n} packages)", in_place=True, after="^The following NEW packages will be installed", words=True, ended_by_dropped=True),),
    ),
    Tool(("aws",), "aws|arn:|InstanceId|----|RoleId", CLOUD, drop=DECORATION, blanks=True, json=True),
    Tool(("az",), "az |AppId|resourceGroup|----", CLOUD, drop=DECORATION, blanks=True, json=True),
    Tool(
        ("bazel",),
        "Loading:|Analyzing:|INFO:|Target //|bazel|Executed ",
        "^ERROR:|FAILED|: error:|^Executed .* out of ",
        drop=r"^Loading:|^Analyzing:|^\[[^\]]+ / [^\]]*\]|^INFO:(?!.*Build completed)|^//.*PASSED",
        blanks=True,
        blocks=(Block("^Target //.*up-to-date:$", r"^[ \t]", before_critical=True),),
        counts=(Count("^Target //|^//", "(+{n} build targets, run `bazel build` for the list)"),),
    ),
    Tool(("biome",), "Checked |biome|lint/|Found |✖", r"^Found .*error|✖|×| error|error\[|^(?=.*lint/).*\.(?:ts|js|tsx|jsx|mts|cts):\d+:\d+", drop=r"^Checking |^[ \t]", blanks=True),
    Tool(("brew",), "==> |brew|Pouring|Homebrew|🍺|Cellar", "^Error|🍺|Pouring", drop="^==> Downloading|^==> Fetching|^==> Installing dependencies", more="^Warning:", blanks=True),
    Tool(("bundle",), "Fetching gem|Using |Bundle complete|bundle|Installing ", "^Bundle complete!|(?i:error)|Could not find|(?i:conflict)|Bundler could not", drop="^Using |^Fetching |^Installing ", blanks=True),
    Tool(("cargo",), r"Compiling |cargo|error\[E|Finished|test result:", r"^error|error\[E|test result: FAILED|^---- .* stdout ----|^thread '.*panicked|could not compile", drop="^Compiling |^Downloading|^Downloaded|^Blocking|^Running |^Finished|^Building", more="^warning:"),
    Tool(("cmake",), r"-- |cmake|CMake|Building CXX|Configuring done|\[ ", r": error:|: fatal error:|^CMake Error|\*\*\* |Error \d", uncritical=": warning:", drop=r"^-- |^\[[^\]]*%[^\]]*\]\s*(?:Building|Linking)", more=": warning:"),
    Tool(("composer",), "composer|Installing |Lock file operations|Loading composer|autoload", "(?i)error|could not|problem|conflict", drop="^- Installing |^- Downloading |^- Extracting |^Loading composer repositories|^Reading ", blanks=True),
    Tool(("curl",), r"\* Trying|\* Connected to|< HTTP|> GET|> POST|curl:|\* SSL|\* TLSv", r"^< HTTP|^curl: \(|^\* SSL certificate problem|^\* Could not resolve host|error", drop=r"^\* (?!Connected to)|^> ", more="^< ", blanks=True),
    Tool(
        ("dnf", "yum"),
        "Dependencies resolved|Transaction Summary|dnf|yum|Installed:|metadata expiration",
        rf"^Error|^No match|^Transaction Summary|^Install .*Package|^Installed:|^Complete!$|^\S*\.(?:{ARCHES})\s+\S",
        drop=r"^Last metadata expiration|^Downloading Packages|^Running transaction|^Transaction test succeeded|^Total download size|^Installed size|kB/s|MB/s| B/s|^(?:Preparing|Installing|Upgrading|Verifying|Cleanup|Removing|Reinstalling|Downgrading) .*:.*[^:]$",
        blanks=True,
        counts=(Count(rf"^ \s*[^\s=]\S*\s+(?:{ARCHES})\s+\S+\s+\S", "  (+{n} packages)", in_place=True, ended_by_dropped=True),),
    ),
    Tool(
        ("docker",),
        "Step |--->|Pulling from|=> |Successfully built|docker",
        "^ERROR|failed to solve|error:|=> ERROR|Successfully built|Successfully tagged|^naming to ",
        drop=r"Pulling fs layer|Waiting|Verifying Checksum|Download complete|Pull complete|Extracting|Downloading|=> => transferring|=> => sha256:|=> => extracting|^---> Using cache|^---> Running in |^(?:sha256:)?[0-9a-f]{8,}: (?=.*\[).*\]",
        blanks=True,
        counts=(Count("^Step ", "  (+{n} build steps)", but_first=True),),
    ),
    Tool(("dotnet",), "Restored |Build succeeded|Build FAILED|dotnet| -> |Determining projects", r"\): error |Build FAILED|^Failed!|Error\(s\)|Failed:", drop="^Determining projects to restore|^Restored | -> ", more=r"\): warning ", blanks=True),
    Tool(("eslint",), "problem|  error  |eslint|✖", "^✖| problems| problem |  error ", drop="  warning ", blanks=True, header=r"^\S.*\.(?:js|ts|jsx|tsx|vue)$", header_lines="  error ", header_ends="^✖| problems| problem ", header_balanced=True),
    Tool(("flyway",), "Flyway|Migrating schema|flyway|migration|Schema version", "^ERROR|^Error|^Migrating schema to version|^Successfully applied|failed", drop="^Flyway.*by Redgate|^Database:|^Successfully validated|^Current version"),
    Tool(("gcloud",), r"gcloud|PROJECT_ID|NAME  |Listed 0 items|Created \[", CLOUD, drop=DECORATION, blanks=True, json=True),
    Tool(("gem",), "gem |Fetching |Successfully installed|gems installed|Parsing documentation", "(?i:error|could not|failed)|^Successfully installed|gems installed", drop="^Fetching |^Building native extensions|^Parsing documentation|^Installing ri documentation|^Installing rdoc|^Done installing documentation", blanks=True),
    Tool(("gh",), "\t|gh|Showing |completed|open|OPEN", "(?i:fail|error|timed_out)|✗|X", drop="^Showing ", keep="^STATUS.*TITLE", blanks=True, counts=(Count(".", "  (+{n} successful)", in_place=True),)),
    Tool(
        ("git",),
        "Changes |Untracked files|nothing to commit|Unmerged paths",
        "^Changes to be committed|^Changes not staged|^Untracked files|^Unmerged paths|^both modified|^modified:|^new file:|^deleted:|^renamed:|^copied:|^typechange:",
        drop=r'^\(use "git|^\(commit or discard|^\(and have|^On branch|^Your branch is|^nothing to commit|^no changes added to commit|^nothing added to commit',
        blanks=True,
        counts=(Count(r'^(?!\(use "git)(?![^/]*:$).', "  (+{n} untracked files, run `git status` for the list)", after="^Untracked files"),),
    ),
    Tool(("golangci-lint",), r"\.go:\d+:\d*:? |issues:|golangci", r"\.go:\d+:\d*:? |^\d+ issues:", drop=r"^\* |^\^[\^ \t]*$|^[ \t]"),
    Tool(("go",), r"=== RUN|--- FAIL|--- PASS|(?:^|\n)ok  \t|\nFAIL\t|no test files", r"^--- FAIL|^FAIL|^panic:|^--- SKIP|\[build failed\]|\[setup failed\]|\.go:\d", drop="^=== RUN|^=== CONT|^=== PAUSE|^=== NAME|^--- PASS|^PASS$", counts=(Count("^ok {1,2}\t", "ok\t(+{n} passing packages)", always=True),)),
    Tool(
        ("gradle",),
        "> Task |BUILD SUCCESSFUL|BUILD FAILED|[gG]radle|> Configure",
        r"^BUILD FAILED|^BUILD SUCCESSFUL|^FAILURE:|^(?:\* )?What went wrong:|^e: |Execution failed for task|: error:|^> Task .*FAILED$",
        drop=r"^> Task |^Download https://|^Starting a Gradle Daemon|^Welcome to Gradle|^Deprecated Gradle features were used|^(?=.*%)[<>=%0-9 \t-]+$",
        blanks=True,
    ),
    Tool(("helm",), "STATUS:|LAST DEPLOYED|REVISION:|helm|NAME:|Release ", "^Error|^STATUS:|failed|pending", more="^LAST DEPLOYED|^NAMESPACE:", blanks=True, blocks=(Block("^NOTES:$", ".*", past_critical=True),)),
    Tool(("jest",), "PASS |FAIL |Tests:|Test Suites:|jest", "^FAIL |●|Expected|Received|failed", drop=r"^PASS |console\.log"),
    Tool(
        ("kubectl", "oc"),
        "NAME |Namespace:|Events:|kubectl",
        f"^NAME |^Warning|{UNHEALTHY}",
        blanks=True,
        drop="^Normal(?: |$)",
        blocks=(Block("^Labels:|^Annotations:", r"^[ \t]"),),
        counts=(Count(".", "  (+{n} healthy rows)", in_place=True),),
        table="(?m)^[ \\t]*NAME ",
    ),
    Tool(("make",), r"make\[|make:|\*\*\* |gcc|cc |g\+\+|clang|Makefile|make ", r"^make:.*Error|\*\*\* |: error:|: fatal error:|Error \d|undefined reference|^ld: ", uncritical=": warning:", drop=r"^make\[|^(?=.{13})(?:gcc|cc|g\+\+|clang|ar|ranlib) ", more=": warning:"),
    Tool(("mix",), "==> |Compiling |Generated |mix|tests,| test ", r"\*\* \(|^error:|failure|^\d+\) test", drop="^==> |^Compiling |^Generated ", more=r"^warning:|\.exs?:", blanks=True),
    Tool(("mvn",), r"\[INFO\]|maven|BUILD SUCCESS|BUILD FAILURE|mvn|Apache Maven", r"^\[ERROR\]|BUILD FAILURE|BUILD SUCCESS|Tests run:|FAIL", drop=r"^\[INFO\]|^Downloading from|^Downloaded from|^Progress", more=r"^\[WARNING\]", blanks=True),
    Tool(("ninja",), r"ninja|\[|Compiling |Linking |build stopped", ": error:|: fatal error:|^FAILED:|^ninja: build stopped|^ninja: error:", uncritical=": warning:", drop=r"^\[[^/\]]*\d/\d[^\]]*\]", more=": warning:"),
    Tool(
        ("nix",),
        "nix|/nix/store/|derivations will be built|building '|copying path",
        "error:|failed|cannot|derivations will be built",
        drop="^building '|^copying path",
        more=r"^(?!.*(?i:error|fail))[^ >]+> ",
        blanks=True,
        blocks=(Block("derivations will be built", r"^[ \t]", start_stays=True, before_critical=True),),
    ),
    Tool(
        ("nomad",),
        "nomad|Allocations|Task Group|Node ID|= running|Status =",
        r"^Status\s*=|^ID |(?i:error|failed|lost|dead|pending)",
        blanks=True,
        blocks=(Block("^Recent Events:|^Placement Metrics"),),
        counts=(Count("^(?!.* = ).*(?i:running|complete)", "  (+{n} healthy allocations)", in_place=True),),
    ),
    Tool(("npm",), "npm |added |packages in", "npm error|npm ERR!|vulnerabilit|^added |^removed |^changed ", drop="^npm http|^npm timing|^npm notice|^reify:|^[ ▀-▟⠀-⣿⸨⸩]+$", blanks=True, counts=(Count("^npm (?:warn|WARN) deprecated", "  (+{n} deprecation warnings)", balanced=True),)),
    Tool(("packer",), "packer|==> |amazon-ebs|Build '|Builds finished", "^==> Builds finished|(?i:error|failed|didn't complete|finished after|artifacts of successful)", drop=r"^[ \t]|^==> .*: ", blanks=True, counts=(Count("^==> ", "  (+{n} build steps)", in_place=True),)),
    Tool(
        ("pip", "pip3"),
        "Collecting |Requirement already satisfied|Successfully installed|pip|Downloading ",
        "^ERROR|error:|Could not find a version|^Successfully installed|^Successfully uninstalled",
        uncritical="^WARNING: You are using pip version",
        drop="^Collecting |^Downloading |^Using cached |^Requirement already satisfied:|^Preparing metadata|^Building wheel|^Created wheel",
        more="^WARNING:",
        blanks=True,
    ),
    Tool(("playwright",), r"Running |workers|✓|✘|playwright|passed \(", r"✘|✗|^Error:|expect\(|Timed out|failed", drop="✓|^Running .*using"),
    Tool(("prettier",), r"\[warn\]|Checking formatting|prettier|Prettier code style|\[error\]", r"Code style issues found|All matched files|^\[error\]|^\[warn\]", drop="^Checking formatting", blanks=True),
    Tool(
        ("pulumi",),
        "Previewing update|pulumi|Resources:|aws:|@ | to create| to update",
        r"^[eE]rror|failed|^Resources:|^@ |^(?:\+-|[+~-]) .*(?::| to create| to update| to delete)",
        drop=r"^[ \t]+(?![ \t]|(?:\+-|[+~-]) ).*:|^Diagnostics:$",
        keep=r"^(?:\+-|[+~-]) ",
        more=".",
        blanks=True,
    ),
    Tool(
        ("pytest",),
        "test session starts| passed| failed|PASSED|====",
        "^FAILED |^ERROR |^E   |^> |^===.*(?:FAILURES|ERRORS)| failed| error|assert",
        drop="^platform |^rootdir:|^plugins:|^cachedir:|^collected .* item|PASSED",
        counts=(Count(r"\.py [. ]*\.[. ]*\[[^\[]*%\]$", "  (+{n} passing test files)"),),
    ),
    Tool(("rspec",), "examples,|Failures:|Finished in|rspec|example,", r"^Failures:$|^\d+\) |^Failure/Error:|^expected|^got|failure", drop=r"^Randomized with seed|^Finished in |^Run options:|^\.+$"),
    Tool(("rubocop",), "Inspecting|offenses|Offenses:|rubocop|files inspected", r"offense|\.rb:\d+:\d+: [A-Z]: ", drop=r"^Inspecting|^[.CWEFR ]+$|^[ \t]", blanks=True),
    Tool(("ruff",), r"\.py:\d+:\d+: [A-Z]+\d+|Found |ruff", r"\.py:\d+:\d+: [A-Z]+\d+|^Found \d+ error", drop=r"^\[\*\].*fixable|^\^[\^ \t]*$|^[ \t]"),
    Tool(("sbt",), r"\[info\]|\[success\]|sbt|Total time|\[error\]", r"^\[error\]|Compilation failed|\[success\]", drop=r"^\[info\]", more=r"^\[warn\]", blanks=True),
    Tool(("swift",), r"swift|Compiling |Build complete|Test Suite|Test Case|\.swift:", ": error:|^error:| failed|failure|^Build complete|^Executed .* tests", drop=r"^\[.*\] Compiling|^Compiling |^Test Case .* passed|^Test Suite .*(?: started| passed)", more=": warning:"),
    Tool(
        ("terraform",),
        "Terraform will perform|Plan:|# |terraform|Apply complete|Refreshing state",
        r"^# |^(?:[+~-]|-/\+) resource|^Plan:|^Apply complete!|^Error|Error:|will be created|will be destroyed|will be updated in-place|will be replaced",
        drop=r": Refreshing state\.\.\.|: Reading\.\.\.|^Initializing|^- (?:Installing|Installed|Reusing|Using|Finding|Downloading)|^Terraform has been successfully initialized|\(known after apply\)|^[ \t]+(?![ \t]|# |(?:[+~-]|-/\+|\+/-) ).*=",
        keep=r"^(?:[+~-]|-/\+|\+/-) .*=",
        more=".",
        blanks=True,
    ),
    Tool(("tsc",), "error TS|Found |tsc", r"\): error TS|^Found .*error", drop=f"^Compiling|^(?:{STATS}):"),
    Tool(("uv",), "Resolved |Installed |uv |Prepared |Audited ", "(?i:error|failed)|^Installed |^Resolved |No solution found", drop=r"^Downloaded |^Prepared |^\+ ", blanks=True),
    Tool(("vitest",), "Test Files|✓|❯|vitest|RERUN", "×|❯|FAIL|failed|AssertionError|Expected|Received", drop="^✓ "),
    Tool(
        ("yarn", "pnpm"),
        "yarn|Resolving packages|Fetching packages|Linking dependencies|Done in|Packages:|Progress:|pnpm",
        "(?i:error)|ERR_|Couldn't find",
        drop=r"^\[[1-4]/4\]|^success Saved lockfile|^Resolving packages|^Fetching packages|^Linking dependencies|^Building fresh packages|^Progress: resolved|^Packages: \+|^warning |^\+ |^- ",
        blanks=True,
    ),
]
