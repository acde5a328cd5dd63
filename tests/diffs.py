"""Inline diff fixtures (our own content) with the shapes the reference tests use."""

NEW_FILE = """diff --git a/lib/math.py b/lib/math.py
new file mode 100644
index 0000000..1a2b3c4
--- /dev/null
+++ b/lib/math.py
@@ -0,0 +1,5 @@
+def double(x):
+    return 2 * x
+
+
+LIMIT = 10
"""

MODIFIED = """diff --git a/app/settings.py b/app/settings.py
index 1a2b3c4..5d6e7f8 100644
--- a/app/settings.py
+++ b/app/settings.py
@@ -3,4 +3,4 @@
 DEBUG = False
-PORT = 8000
+PORT = 8080
 HOST = "0.0.0.0"
"""

DELETED = """diff --git a/legacy/util.py b/legacy/util.py
deleted file mode 100644
index 5d6e7f8..0000000
--- a/legacy/util.py
+++ /dev/null
@@ -1,3 +0,0 @@
-def old():
-    pass
-
"""

RENAMED = """diff --git a/docs/guide.md b/docs/user/guide.md
similarity index 88%
rename from docs/guide.md
rename to docs/user/guide.md
index 1111111..2222222 100644
--- a/docs/guide.md
+++ b/docs/user/guide.md
@@ -1,3 +1,4 @@
 # Guide
 Install the package.
 Run the tool.
+Read the FAQ.
"""

BINARY = """diff --git a/assets/logo.png b/assets/logo.png
new file mode 100644
index 0000000..abcdef0
Binary files /dev/null and b/assets/logo.png differ
"""

TWO_FILES = """diff --git a/src/x.js b/src/x.js
index 1111111..2222222 100644
--- a/src/x.js
+++ b/src/x.js
@@ -1,2 +1,3 @@
 const a = 1;
+const b = 2;
 module.exports = { a };
diff --git a/src/y.js b/src/y.js
index 3333333..4444444 100644
--- a/src/y.js
+++ b/src/y.js
@@ -1,2 +1,2 @@
-const { a } = require('./x');
+const { a, b } = require('./x');
 console.log(a);
"""

TWO_HUNKS = """diff --git a/server.js b/server.js
index aaaaaaa..bbbbbbb 100644
--- a/server.js
+++ b/server.js
@@ -1,3 +1,4 @@
 const http = require('http');
+const url = require('url');

 const port = 80;
@@ -20,2 +21,5 @@
 server.listen(port);
+
+process.on('SIGTERM', () => {
+  server.close();
+});
"""

ALL = {"new": NEW_FILE, "modified": MODIFIED, "deleted": DELETED, "renamed": RENAMED,
       "binary": BINARY, "two_files": TWO_FILES, "two_hunks": TWO_HUNKS, "empty": ""}


def hundred_files() -> str:
    out = []
    for i in range(100):
        out.append(f"diff --git a/pkg/m{i}.py b/pkg/m{i}.py\nindex 1111111..2222222 100644\n"
                   f"--- a/pkg/m{i}.py\n+++ b/pkg/m{i}.py\n@@ -1,3 +1,10 @@\n keep = True\n"
                   + "".join(f"+value_{k}_{i} = {k}\n" for k in range(7)) + " done = keep\n")
    return "".join(out)
