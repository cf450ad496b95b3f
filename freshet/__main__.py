import sys

from freshet.cli import main

sys.exit(main())
