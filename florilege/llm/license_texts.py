"""Wording of licenses as templates, in words of lower case. `[[ ... ]]` may be left out; `{{n}}` stands for 0 to n words."""

#: Phrase and label of the base scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

MIT_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
    "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
    "with the software or the use or other dealings in the software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution"
)
BSD_WARRANTY = (
    "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
GNU_NOTICE = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software "
    "foundation [[either]] version {version} of the license [[or at your option any later version]]"
)

#: Label and template.
TEMPLATES = (
    ("apache-2-notice", "licensed under the apache license version 2 0 [[the license]]"),
    (
        "apache-2-header",
        "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
    ),
    ("bsd-2-text", f"{BSD} {BSD_WARRANTY}"),
    (
        "bsd-3-text",
        f"{BSD} [[3]] neither the name of {{{{12}}}} nor the names of [[its]] [[other]] contributors may be used to endorse or promote products derived from this software without "
        f"specific prior written permission {BSD_WARRANTY}",
    ),
    (
        "boost-1-text",
        "[[boost software license version 1 0 august 17th 2003]] permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works "
        "of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this "
        "entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part "
        "and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source "
        "language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or "
        "other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("cc-by-notice", "licensed under a creative commons attribution {{2}} [[international]] [[unported]] license"),
    ("cc-by-nc-notice", "licensed under [[a]] [[the]] cc by nc [[sa]] [[nd]] {{2}} [[license]]"),
    ("cc-by-nc-notice", "licensed under a creative commons attribution noncommercial {{2}} [[international]] [[unported]] license"),
    ("cc0-notice", "to the extent possible under law {{12}} has waived all copyright and related or neighboring rights to"),
    ("epl-2-notice", "made available under the terms of the eclipse public license [[v]] [[version]] 2 0"),
    ("gpl-notice", "licensed under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[version {{2}}]]"),
    ("gpl-2-header", GNU_NOTICE.format(name="general", version="2")),
    ("gpl-3-header", GNU_NOTICE.format(name="general", version="3")),
    ("lgpl-2-1-header", GNU_NOTICE.format(name="lesser general", version="2 1")),
    ("lgpl-3-header", GNU_NOTICE.format(name="lesser general", version="3")),
    ("agpl-3-header", GNU_NOTICE.format(name="affero general", version="3")),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and {{4}} disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall {{4}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
        "use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("mit-notice", "under the [[terms of the]] mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next "
        "paragraph]] shall be included in all copies or substantial portions of the software " + MIT_WARRANTY,
    ),
    (
        "mpl-2-header",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "[[http]] [[https]] [[www]] mozilla org mpl 2 0",
    ),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "wtfpl-text",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed {{9}} public "
        "license terms and conditions for copying distribution and modification 0 you just do what the {{1}} you want to",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to "
        "the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software "
        "in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and "
        "must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any [[source]] distribution",
    ),
)
