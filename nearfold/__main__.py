import sys

from nearfold.cli import main

sys.exit(main())
